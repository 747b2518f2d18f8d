"""Results held against brute force, and the defined value of every odd case."""

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomledger.llm import decontaminate, language_id, license_scan, near_dedup, oracles, packing, quality_classifier, quality_rules, secrets
from tests.llm.test_llm_operators import PROSE, docs, windows_in

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _match string, parts string, `row` string, found string, _of_row string, _kept_id string, mark string, salt string, `a.b` string"


def clashing(spark, rows):
    """Rows (doc_id, text, lang, source) with columns named as operators name their own."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), *"abcdefghi") for i, t, lang, src in rows], CLASH)


SECRET = 'password = "hunter2x!q" end'
ROWS = [(1, None, "en", "s"), (2, "", None, None), (3, " \n", "en", "s"), (4, PROSE * 3, "en", "s"), (5, PROSE * 3, "en", "s"), (None, PROSE * 3, None, None), (None, SECRET, "en", None), (7, SECRET, "en", "s"), (7, SECRET, "en", "s"), (8, "q" * 300_000, "en", "s")]


def test_redaction_keeps_rows_columns_and_order_of_values(spark):
    rows = clashing(spark, ROWS)
    out = secrets.redact(rows)
    assert out.columns == rows.columns
    clean = SECRET.replace("hunter2x!q", "[SECRET]")
    want = [(i, clean if t == SECRET else t, lang, s, len(clean if t == SECRET else t or ""), *"abcdefghi") for i, t, lang, s in ROWS]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    found = secrets.scan(rows).filter("is_secret").collect()
    assert [(r.start, r.end, r.secret_sha256) for r in found] == [(12, 22, hashlib.sha256(b"hunter2x!q").hexdigest())] * 3
    assert secrets.redact(rows.limit(0)).count() == secrets.scan(rows.limit(0)).count() == 0


def test_secret_patterns_take_linear_time(spark):
    units = ["=", "-", "/", "a", "0", "password", "password ", "a.", "a://b:", "-----BEGIN PRIVATE KEY-----", "eyJaaaaaaaaa.", "api key ", "password=", '="', "A=1 "]
    rows = spark.createDataFrame([(i, u * (1_000_000 // len(u))) for i, u in enumerate(units)], "doc_id long, text string")
    began = time.time()
    assert rows.filter(F.col("text").rlike(secrets.PROPOSE)).count() >= 0
    assert rows.select(F.size(F.split("text", secrets.PROPOSE)).alias("n")).agg(F.sum("n")).first()[0] >= len(units)
    assert time.time() - began < 60


def test_forest_on_findings_it_has_not_seen(spark):
    trees = secrets.trained(docs(spark, []))
    rows = spark.createDataFrame(secrets.labelled(3000, seed=secrets.SEED + 1), "candidate string, before string, label int")
    said = rows.select("label", (secrets.vote(trees, secrets.features(F.col("candidate"), F.col("before"))) >= secrets.THRESHOLD).alias("said"))
    n = {(r.label, r.said): r["count"] for r in said.groupBy("label", "said").count().collect()}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((0, True), 0))
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))


def near_of(texts, items):
    """n_near per text, by all pairs of places of each window's two rarest words."""
    df = {}
    vocabulary = {w for _, item in items for w in item}
    for words in texts:
        for w in words:
            df[w] = df.get(w, 0) + (w in vocabulary)
    out = []
    for words in texts:
        near = set()
        for name, item in items:
            k = min(10, len(item))
            for s in range(len(item) - k + 1 if k else 0):
                rank = sorted((df.get(item[s + i], 0), i) for i in range(k))
                if not rank[0][0]:
                    continue
                a = [p for p, w in enumerate(words) if w == item[s + rank[0][1]]]
                if k == 1:
                    near |= {name} if a else set()
                    continue
                b = [p for p, w in enumerate(words) if w == item[s + rank[1][1]]]
                delta = rank[1][1] - rank[0][1]
                if any(p != q and abs(q - p - delta) <= decontaminate.SLOP for p in a for q in b):
                    near.add(name)
        out.append(len(near))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, -1])
def test_near_and_exact_items(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    r = random.Random(17)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 90}"
    items = [(str(i), [word() for _ in range(r.choice([0, 1, 2, 9, 10, 14, 30]))]) for i in range(14)]
    texts = []
    for _ in range(24):
        words = [word() for _ in range(r.randint(0, 60))]
        item = list(r.choice(items)[1])
        for _ in range(r.choice([0, 0, 1, 3])):
            item.insert(r.randint(0, len(item)), "zz")
        texts.append(words + item + words[:5])
    texts += [texts[0], [], ["w1"] * 40]
    got = {x.doc_id: x for x in decontaminate.contaminated(docs(spark, [" ".join(t) for t in texts]), spark.createDataFrame([(int(i), " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    for i, (t, near) in enumerate(zip(texts, near_of(texts, items), strict=True)):
        _, hit, found = windows_in(t, items)
        assert (got[i].n_hit, got[i].n_items, got[i].n_near) == (hit, len(found.split(",")) if found else 0, near), i


def test_texts_and_items_that_repeat_themselves(spark):
    bench = spark.createDataFrame([(1, "a " * 5000), (2, "b a " * 2000), (3, "a " * 9 + "c")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, ["a " * 20_000, "b a " * 10_000, "a " * 9, "x " * 20_000]), bench).collect()}
    assert [(got[i].n_hit, got[i].n_items) for i in range(4)] == [(20_000, 1), (20_000, 1), (0, 0), (0, 0)]


def test_clean_rows_stay_whatever_their_ids(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    out = decontaminate.keep_clean(clashing(spark, ROWS + [(4, "another text of the same id", "en", "s")]), bench)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(i, t) for i, t, _, _ in ROWS if t != PROSE * 3] + [(4, "another text of the same id")], key=repr)


def sets_of(texts):
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]


def linked(sets):
    comp = list(range(len(sets)))
    pairs = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            pairs += 1
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    return comp, pairs


@pytest.mark.parametrize(("block", "group", "salts"), [(64, 16, 64), (3, 2, 2)])
def test_near_groups_in_hot_buckets(spark, monkeypatch, block, group, salts):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "SALTS", salts)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(260):  # a third are chains of steps away from one text, so that buckets hold several components
        w = list(base) if i % 3 else [f"v{i % 7}x{k}" for k in range(60)]
        for k in range(r.randint(0, 8)):
            w[(i * 5 + k) % 60] = f"z{r.randrange(4)}"
        texts.append(" ".join(w))
    comp, pairs = linked(sets_of(texts))
    got = {x.doc_id: x.component_id for x in near_dedup.groups(docs(spark, texts)).collect()}
    assert pairs > 500
    assert got == dict(enumerate(comp))  # recall of links 1: every group is whole


def test_near_groups_of_long_texts_in_small_batches(spark, monkeypatch):
    def bounded(f):
        def held(batches):
            for pdf in batches:
                sizes = [sum(len(v) for v in row if isinstance(v, str | bytes)) for row in pdf.itertuples()]
                assert sum(sizes[:-1]) <= 2 << 20, (len(pdf), sum(sizes))
                yield from f(iter([pdf]))

        return held

    for name in ("_digest", "_signed", "_hashed", "_verify", "_against_pivot"):
        monkeypatch.setattr(near_dedup, name, bounded(getattr(near_dedup, name)))
    texts = [" ".join(f"g{i % 2}w{k}" for k in range(25_000)) + f" end{i}" for i in range(24)]
    got = {x.doc_id: x.component_id for x in near_dedup.groups(docs(spark, texts).coalesce(1)).collect()}
    assert got == {i: i % 2 for i in range(24)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_long_words_are_not_kept():
    known = near_dedup._hash_of.__self__
    word = b"x" * 100_000
    assert near_dedup.word_hashes(f"short {word.decode()}").tolist() == [xxhash.xxh3_64_intdigest(w) for w in (b"short", word)]
    assert b"short" in known and word not in known


def test_near_rows_without_ids(spark):
    rows = clashing(spark, ROWS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(rows).collect()), key=repr)
    n = len({tuple((PROSE * 3).split()[k : k + 5]) for k in range(62)})
    assert [g for g in got if g[1] == n] == [(4, n, 4, True), (5, n, 4, False), (None, n, 4, False)]
    assert (None, 1, 7, False) in got and got.count((7, 1, 7, True)) == 2 and (1, 0, 1, True) in got
    kept = near_dedup.keep_one(rows).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 7, 8]
    alone = near_dedup.keep_one(clashing(spark, [(None, "one text", "en", "s"), (None, "one text", "en", "s"), (None, "another", "en", "s")])).collect()
    assert sorted(r.text for r in alone) == ["another", "one text"]


def test_junk_does_not_loosen_a_source(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 7)))
    clean = lambda n: " ".join(word() for _ in range(n))
    junk = lambda n: " ".join(word() + r.choice(["#", "$$", "|"]) for _ in range(n))
    rows = [(i, (junk if i % 100 < 36 else clean)(r.randint(80, 200)), "en", "mixed") for i in range(400)]
    rows += [(1000 + i, clean(r.randint(80, 200)), "en", "clean") for i in range(1000)] + [(5000, clean(300), None, None), (None, clean(300), "xx", "new"), (None, junk(300), "xx", "new")]
    kept = {(r.doc_id, r.text) for r in quality_rules.keep_good(clashing(spark, rows)).collect()}
    for i, t, _, s in rows:
        assert ((i, t) in kept) == (not re.search("[#$|]", t)), (i, s)
    odd = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(clashing(spark, ROWS[:5])).collect()}
    assert odd == {1: (0, True, False), 2: (0, True, False), 3: (0, True, False), 4: (66, True, False), 5: (66, True, False)}


def test_quality_groups_beyond_a_broadcast(spark, monkeypatch, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, quality_rules.judge(d).select("doc_id", "kept").collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", -1)
    assert sorted(map(tuple, quality_rules.judge(d).select("doc_id", "kept").collect())) == want


def test_every_subset_of_notices(spark):
    picks = [c for n in (1, 2, 3) for c in itertools.combinations(range(len(license_scan.TEMPLATES)), n)]
    texts = [" zz qq ".join(license_scan.TEMPLATES[i][2].upper() if len(c) == 1 else license_scan.TEMPLATES[i][2] for i in c) for c in picks]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)) + [(9000, None), (9001, ""), (9001, ""), (None, "MiT LiCeNsE mit license")])
    rows = spark.createDataFrame(list(enumerate(texts)) + [(9000, None), (9001, ""), (9001, ""), (None, "MiT LiCeNsE mit license")], "doc_id long, text string")
    got = license_scan.scan(rows).collect()
    want = con.execute(oracles.LICENSE_SCAN)
    order = [c[0] for c in want.description]
    assert sorted((tuple(r[c] for c in order) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
    by_id = {r.doc_id: set(r.labels.split(",")) for r in got}
    for i, c in enumerate(picks):
        assert by_id[i] >= {license_scan.TEMPLATES[k][0] for k in c}, c


def test_scores_against_plain_python(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.train(d, labels)

    def features(t):
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        n, m = max(1, len(t)), max(1, len(words))
        count = lambda p: len(re.findall(p, t))
        distinct = len(set(words))
        values = [len(t), count("[#*$%&<>@^~=]") / m, count("!") / m, count(r"\|") / m, count("[A-Z]") / n, count("[0-9]") / n, count("\n") / m, sum(map(len, words)) / m, distinct / m**0.5, distinct / m, count("[.]") / m]
        return np.log1p(values)

    def score(t):
        raw = ((features(t) - model["mean"]) / model["std"]) @ np.array(model["w"]) - model["cut"]
        return 1 / (1 + np.exp(-(raw + np.log(0.7 / 0.3))))

    got = quality_classifier.score(d.unionByName(d.limit(1).withColumn("text", F.lit(None).cast("string"))), model).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    first = d.limit(1).first().doc_id
    assert len(got) == len(texts) + 1
    for r in got:
        assert min(abs(r.score - score(texts[r.doc_id])), abs(r.score - score(None)) if r.doc_id == first else 1) < 1e-9
        assert r.predicted == int(r.score >= 0.7)
    # more distinct words count, however many there are already
    many = [quality_classifier.features(F.lit(" ".join(f"w{i}" for i in range(n))))[8] for n in (2_000, 4_000, 40_000, 80_000)]
    values = spark.range(1).select(*many).first()
    assert all(b - a > 0.3 for a, b in zip(values, values[1:], strict=False))
    # an id that stands often is learned from once
    often = quality_classifier.train(d.unionByName(d).unionByName(d), labels)
    assert often["w"] == pytest.approx(model["w"]) and often["cut"] == pytest.approx(model["cut"])
    none = quality_classifier.judged(d.limit(3), labels.limit(0)).collect()
    assert [r.score for r in none] == pytest.approx([0.7] * 3)
    # what was minimised, over all pairs: no direction away from the weights lowers it by much
    x = {k: np.array([features(texts[r.doc_id]) for r in labels.collect() if r.quality == k and r.doc_id in texts]) / model["std"] for k in (0, 1)}
    diff = (x[1][:, None] - x[0][None]).reshape(-1, len(quality_classifier.FEATURES))
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + quality_classifier.RIDGE * (w @ w) / 2
    assert loss(np.array(model["w"])) < 0.5 * loss(np.zeros(diff.shape[1]))


def test_every_labelled_row_counts(spark):
    """9,000 rows, of which no bounded sample knows the mean; the weights are the least of all pairs' loss, and the cut parts as many rows as are bad."""
    r = np.random.default_rng(4)
    quality = r.random(9_000) < 0.6
    x = r.normal(size=(9_000, 11)) + quality[:, None] * np.linspace(0, 1, 11)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quality)], "doc_id long, quality int")
    model = quality_classifier._trained(rows, labels)
    learned = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in range(len(x))])
    x, quality = x[learned], quality[learned]
    assert len(x) > 6_500
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["std"], x.std(0) + 1e-6)
    z, w = (x - x.mean(0)) / x.std(0), np.array(model["w"])
    gradient, good, bad = quality_classifier.RIDGE * w, z[quality], z[~quality]
    for at in range(0, len(good), 200):
        p = 1 / (1 + np.exp((good[at : at + 200] @ w)[:, None] - (bad @ w)[None]))
        gradient = gradient + (p.sum(0) @ bad - p.sum(1) @ good[at : at + 200]) / len(good) / len(bad)
    assert np.abs(gradient).max() < 1e-4
    scores = np.sort(z @ w)
    n = int((~quality).sum())
    assert model["cut"] == pytest.approx((scores[n - 1] + scores[n]) / 2, abs=1e-4)
    assert quality_classifier._cut(spark.createDataFrame([(float(v),) for v in (1, 2, 2, 2, 5)], "s double"), 2) == 2.0


def test_network_against_plain_loops():
    model = {k: v.astype(np.float64) for k, v in language_id.new_model(3).items()}
    texts, h = ["short", "é" * 70 + " and a text of more than one window of bytes", "", None, "12 34"], model["uf"].shape[1]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def run(w, u, data):
        s, out = np.zeros(h), []
        for b in data:
            a, g = u @ s, w[:, b]
            z, r = sig(g[:h] + a[:h]), sig(g[h : 2 * h] + a[h : 2 * h])
            n = np.tanh(g[2 * h :] + r * a[2 * h :])
            s = (1 - z) * n + z * s
            out.append(s)
        return out

    want = []
    for t in texts:
        total, data = np.zeros(3), (t or "").encode()
        for at in range(0, len(data), language_id.WINDOW):
            part = data[at : at + language_id.WINDOW]
            for f, b in zip(run(model["wf"], model["uf"], part), reversed(run(model["wb"], model["ub"], part[::-1])), strict=True):
                e = np.exp(model["v"] @ np.concatenate([f, b]) + model["c"][:, 0])
                total += e / e.sum()
        want.append(total / max(1, len(data)))
    names, scores = language_id.predict(texts, ["x", "y", "z"], model)
    for t, name, score, w in zip(texts, names, scores, want, strict=True):
        if any(map(str.isalpha, t or "")):
            assert name == "xyz"[w.argmax()] and abs(score - w.max()) < 1e-4
        else:
            assert (name, score) == ("und", 0.0)


def test_languages_of_odd_rows(spark):
    nothing = language_id.identify(clashing(spark, [(2, "some text", None, "s"), (3, "more", "und", "s")])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    rows = [(i, ("the cat and " if i % 2 else "ñandú él más ") * 30, "en" if i % 2 else "es", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 !", "en", "s"), (None, "the cat and the cat", None, None), (1, rows[1][1], "en", "s")]
    got = language_id.identify(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(by_id[i][0].lang_pred == "und" and by_id[i][0].score == 0 for i in (100, 101, 102))
    assert by_id[None][0].lang_pred == "en" and not by_id[None][0].held_out
    assert [r.lang_pred for r in by_id[1]] == ["en", "en"]


def best_cost(lengths, capacities):
    """The least total cost of any packing, by trying every partition."""
    if not lengths:
        return 0.0
    first, rest = lengths[0], lengths[1:]
    out = float("inf")
    for k in range(len(rest) + 1):
        for mates in itertools.combinations(range(len(rest)), k):
            held = first + sum(rest[i] for i in mates)
            if held <= max(capacities):
                own = packing.cost(min(c for c in capacities if c >= held))
                out = min(out, own + best_cost([x for i, x in enumerate(rest) if i not in mates], capacities))
    return out


def test_packing_near_the_optimum():
    r = random.Random(6)
    ratios = []
    for _ in range(60):
        lengths = sorted((r.choice([r.randint(1, 4096), r.randint(1, 1500), r.randint(200, 400)]) for _ in range(7)), reverse=True)
        placed, capacities = packing.pack(lengths)
        used = [0] * len(capacities)
        for (b, start), n in zip(placed, lengths, strict=True):
            assert start == used[b]
            used[b] += n
        assert all(u <= c for u, c in zip(used, capacities, strict=True))
        ratios.append(sum(map(packing.cost, capacities)) / best_cost(lengths, packing.CAPACITIES))
    assert sum(ratios) / len(ratios) < 1.08 and max(ratios) < 1.6


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    got = packing.packed(clashing(spark, ROWS)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted([(i, len((t or "").split())) for i, t, _, _ in ROWS], key=repr)
    assert all((r.bin is None) == (r.n_tokens == 0) for r in got)
    assert packing.packed(clashing(spark, ROWS).limit(0)).count() == 0
    many = packing.packed(spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))).collect()
    shards = [r.bin.split("-")[0] for r in many]
    assert len(many) == 400 and max(map(shards.count, set(shards))) < 120  # rows without an id spread


def test_pipeline_against_sql_and_plain_python(spark, sf, tmp_path):
    import corpus_pipeline as p

    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf}/benchmark.parquet')")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), sql, rule in zip(p.STAGES[:3], (oracles.QUALITY_RULES, oracles.NEAR_DEDUP, oracles.DECONTAMINATE), ("kept", "kept", "NOT contaminated"), strict=True):
        con.execute(f"CREATE TEMP TABLE kept AS SELECT doc_id FROM ({sql}) WHERE {rule}")
        con.execute("DELETE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)")
        con.execute("DROP TABLE kept")
        d = near_dedup.written(stage(spark, d, sf), "stage")
        assert sorted(r.doc_id for r in d.select("doc_id").collect()) == [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()], name
    spans = {}
    for r in secrets.scan(d).filter("is_secret").collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    texts = {}
    for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall():
        for a, b in sorted(spans.get(i, []), reverse=True):
            t = t[:a] + "[SECRET]" + t[b:]
        texts[i] = t
    assert {r.doc_id: r.text for r in p.secret_scan(spark, d, sf).collect()} == texts
    rows = p.run(spark, sf).collect()
    tokens, bins = {}, {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault((r.bin, r.capacity), []).append((r.start, r.n_tokens))
    assert tokens == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    for (_, capacity), parts in bins.items():
        ends = [s + n for s, n in sorted(parts)]
        assert [0, *ends[:-1]] == [s for s, _ in sorted(parts)] and capacity == min(c for c in packing.CAPACITIES if c >= ends[-1])
