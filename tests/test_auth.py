"""Arrivals, signatures against published vectors, the event gate, countersignatures, generators and device identity."""

import random

import pytest
from pyspark.sql import functions as F

from loomledger.functions import ed25519
from loomledger.functions.canonical import hash_of
from loomledger.operators import auth, identity, revoke, sync
from loomledger.operators.validate import accepted
from loomledger.sources import generate

#: Seed, public key, message and signature of RFC 8032, section 7.1, tests 1 to 3.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", b"", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", b"r", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize("seed,public,message,signature", VECTORS)
def test_published_vectors(seed, public, message, signature):
    pem, private = ed25519.key_pair(bytes.fromhex(seed))
    assert ed25519._key_bytes(pem, ed25519._PUBLIC_HEAD).hex() == public
    assert ed25519.sign(private, message.decode()) == signature
    assert ed25519.verify(pem, message.decode(), signature)
    assert not ed25519.verify(pem, message.decode() + "x", signature)
    for bad in (None, "", "zz", signature[:-2], signature[:64] + "ff" * 32):
        assert not ed25519.verify(pem, message.decode(), bad)
    assert not ed25519.verify("no key", "", signature) and not ed25519.verify(None, "", signature)


KEYS = [ed25519.key_pair(bytes([i]) * 32) for i in range(1, 4)]
EVENT = "id string, seq long, type string, actor string, device_id string, ts_device long, payload string, prev_hash string, hash string, signature string, countersignatures array<struct<deviceId:string,signatureHex:string>>"


def event(i, device, value, signers=(), signature=True, tampered=False, kind="entry"):
    e = {"id": f"e{i}", "seq": i, "type": kind, "actor": None, "device_id": f"d{device}", "ts_device": i, "payload": f'{{"value":{value}}}', "prev_hash": "GENESIS"}
    e["hash"] = hash_of(e)
    sign = lambda k: ed25519.sign(KEYS[k][1], e["hash"])
    e["signature"] = sign(device) if signature is True and device < 3 else signature or None
    e["countersignatures"] = [(f"d{k}", sign(k) if k < 3 else "00") for k in signers]
    return e | ({"payload": '{"value":9}'} if tampered else {})


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([(f"d{i}", KEYS[i][0]) for i in range(3)], "device_id string, pem string")


def test_event_gate(spark, registry):
    rows = {
        1: (event(1, 0, 5), True), 2: (event(2, 0, 5, tampered=True), False), 3: (event(3, 0, 5, signature=""), False), 4: (event(4, 0, 5, signature=ed25519.sign(KEYS[1][1], "x")), False),
        5: (event(5, 7, 5), False), 6: (event(6, 1, 100, signers=[0, 2]), True), 7: (event(7, 1, 100, signers=[0, 0]), False), 8: (event(8, 1, 100), False),
        9: (event(9, 1, 100, signers=[0, 9]), False), 10: (event(10, 1, '"x"'), True), 11: (event(11, 1, 100, kind="note"), True),
    }
    events = spark.createDataFrame([e for e, _ in rows.values()], EVENT)
    got = {r.seq: r.authentic for r in auth.authentic(events, registry, limit=50, threshold=2).collect()}
    assert got == {k: ok for k, (_, ok) in rows.items()}
    assert auth.authentic(events, None).filter("authentic").count() == len(rows)
    plain = {r.seq for r in auth.authentic(events, registry).filter("authentic").collect()}
    assert plain == {1, 6, 7, 8, 9, 10, 11}
    assert auth.authentic(events.limit(0), registry, 50, 2).count() == 0


@pytest.mark.parametrize("threshold", [0, 4, 1.5, True])
def test_thresholds_that_cannot_be_met(spark, registry, threshold):
    with pytest.raises(ValueError):
        auth.countersigned(spark.createDataFrame([event(1, 0, 5)], EVENT), registry, threshold)


def test_lifetimes(spark):
    """A token may be used before issuedAt, a grant not; both end after expiresAt; one whose end is not after its start is unfit."""
    token = {"id": "t", "deviceId": "d", "scopes": ["b", "a"], "issuedAt": 10, "expiresAt": 20, "notBefore": None}
    text = '{"id":"t","deviceId":"d","scopes":["a","b"],"issuedAt":10,"expiresAt":20}'
    rows = [(now, token | {"signature": ed25519.sign(KEYS[0][1], text)}) for now in (5, 10, 20, 21)]
    asks = spark.createDataFrame(rows, f"now long, token {auth.TOKEN}").withColumn("scope", F.lit("a"))
    none = spark.createDataFrame([], "id string")
    keys = spark.createDataFrame([("d", KEYS[0][0])], "device_id string, pem string")
    assert {r.now: r.refused is None for r in auth.authorized(asks, keys, none, none).collect()} == {5: True, 10: True, 20: True, 21: False}
    grant = {"id": "g", "deviceId": "d", "scopes": ["a"], "issuedBy": "o", "issuedAt": 10, "expiresAt": 20}
    signed = ed25519.sign(KEYS[0][1], '{"id":"g","deviceId":"d","scopes":["a"],"issuedBy":"o","issuedAt":10,"expiresAt":20}')
    asks = spark.createDataFrame([(now, grant | {"signature": signed}) for now in (5, 10, 20, 21)], f"now long, grant {auth.GRANT}").withColumn("scope", F.lit("a"))
    assert {r.now: r.refused is None for r in auth.granted(asks, KEYS[0][0], none).collect()} == {5: False, 10: True, 20: True, 21: False}


def test_corpus(spark):
    events = generate.corpus_frame(spark, spark.createDataFrame([(42, 200), (7, 0)], "seed long, n long"))
    assert [tuple(r) for r in generate.manifest(events).collect()] == [(42, 97, 40, 27, 36)]
    assert generate.corpus(42, 50) == generate.corpus(42, 200)[:50]


def test_faults_of_a_log():
    log = b'{"a":1}\n{"b":2}\n{"c":3}\n'
    assert generate.line_bounds(log) == [(0, 8), (8, 16), (16, 24)]
    assert generate.with_byte(log, 9, ord("#")) == b'{"a":1}\n{#b":2}\n{"c":3}\n'
    assert generate.without(log, 19) == b'{"a":1}\n{"b":2}\n{"c'
    assert generate.without(log, 8, 16) == b'{"a":1}\n{"c":3}\n'
    assert [k for k, _, _ in generate.faults(log, 1, 9)] == [k for k, _, _ in generate.faults(log, 1, 9)]
    assert all(bad != log for _, _, bad in generate.faults(log, 1, 50))


def test_device_identity():
    first, meta = identity.adopt({})
    assert identity.adopt(meta) == (first, meta)
    given, meta = identity.adopt(meta, "till-1")
    assert (given, meta["device.explicit"]) == ("till-1", "1") and identity.adopt(meta, "till-1") == ("till-1", meta)
    with pytest.raises(identity.DeviceMismatch):
        identity.adopt(meta, "till-2")
    assert identity.cursor(meta, "ack.seq") == 0


def test_arrivals_against_reading_one_by_one(spark):
    r = random.Random(5)
    rows = [(r.randrange(25), f"e{r.randrange(25)}", "unfit" if r.random() < 0.1 else None) for _ in range(90)] + [(None, "e1", "event without seq")]
    ids, seqs, want = set(), set(), []
    for seq, key, bad in sorted((x for x in rows if not x[2]), key=lambda x: x[:2]):
        word = "duplicate" if key in ids else "collision" if seq in seqs else "applied"
        if word == "applied":
            ids.add(key)
            seqs.add(seq)
        want.append((seq, key, word))
    want += [(seq, key, "poison") for seq, key, bad in rows if bad]
    df = spark.createDataFrame(rows, "seq long, id string, poison_reason string")
    assert sorted(map(str, [(x.seq, x.id, x.disposition) for x in accepted(df).collect()])) == sorted(map(str, want))
    assert accepted(df.limit(0)).count() == 0


def test_relays():
    assert sync.relay_order([0, 90, 0, 40], 50) == [0, 2, 3, 1]
    assert sync.outbox_full(50_000, 0) and not sync.outbox_full(50_000, 1)


def test_signed_revocations(spark):
    pem, private = KEYS[0]
    good = revoke.signed(private, "ann", "t1", "d1", 2, 77)
    rows = {
        "good": (good, None), "edit": (good | {"epoch": 3}, "hash mismatch (tampered payload?)"), "split": (good | {"id": "x"}, "id/hash split"), "version": (good | {"v": 2}, "unsupported v 2"),
        "admin": (revoke.signed(private, "bob", "t1", "d1", 2, 77), "unknown admin bob"), "key": (revoke.signed(KEYS[1][1], "ann", "t1", "d1", 2, 77), "bad admin signature"),
        "sig": (good | {"sig": None}, "bad admin signature"), "token": (good | {"tokenId": ""}, "empty tokenId"), "epoch": (good | {"epoch": -1}, "bad epoch -1"), "time": (good | {"issuedAt": None}, "bad issuedAt"),
    }
    events = spark.createDataFrame([e | {"name": k} for k, (e, _) in rows.items()], revoke.SIGNED + ", name string")
    admins = spark.createDataFrame([("ann", pem)], "admin string, pem string")
    assert {r.name: r.rejected for r in revoke.verified(events, admins).collect()} == {k: why for k, (_, why) in rows.items()}
    with pytest.raises(ValueError):
        revoke.signed(private, "ann", "", "d1", 0, 1)


def test_multiples_from_tables(monkeypatch):
    """Tables give the multiples that doubling gives, for scalars with digits of zero and of ones, and for keys of one use as of many."""
    rng = random.Random(5)
    for bits in (3, 4, 8):
        table = ed25519._table(ed25519._BASE, bits)
        for k in (0, 1, 255, 256, ed25519._ORDER - 1, 1 << 254, rng.getrandbits(255)):
            assert ed25519._encoded(ed25519._added((0, 1, 1, 0), k, table, bits)) == ed25519._encoded(ed25519._times(k, ed25519._BASE))
    monkeypatch.setattr(ed25519, "_verifier", ed25519.functools.lru_cache(2)(ed25519._verifier.__wrapped__))  # three keys in turn: some come back without their table
    for n in range(30):
        own = n % 3 if n < 15 else 0
        public, private = KEYS[own]
        signature, text = ed25519.sign(private, f"many {n}"), f"many {n}"
        assert ed25519.verify(public, text, signature) and not ed25519.verify(public, text + "x", signature)
        assert not ed25519.verify(KEYS[(own + 1) % 3][0], text, signature)


def test_signatures_use_every_task(spark, registry):
    """A file of one partition is spread before its signatures are verified."""
    events = spark.createDataFrame([event(i, 0, 100, signers=[0, 1]) for i in range(1, 9)], EVENT).coalesce(1)
    core = revoke.signed(KEYS[0][1], "a", "t", "d", 1, 5)
    revokes = spark.createDataFrame([core] * 8, revoke.SIGNED).coalesce(1)
    admins = spark.createDataFrame([("a", KEYS[0][0])], "admin string, pem string")
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert tasks(events) == 1 and tasks(revokes) == 1
    assert tasks(auth.authentic(events, registry)) > 1 and tasks(revoke.verified(revokes, admins)) > 1
    assert auth.countersigned(events, registry, 2).filter("met and valid = 2").count() == 8
    assert revoke.verified(revokes, admins).filter("rejected is null").count() == 8
