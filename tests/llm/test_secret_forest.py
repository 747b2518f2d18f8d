"""The secret scan's forest: texts decided rightly, findings of held-out documents, and features and votes in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomledger.llm import secrets
from tests.llm.test_llm_operators import docs

# what only looks like a credential's value
FALSE = [
    "author: Smith2020x", "secretary: Johnson1984", "authority=ISO27001x", "secret_santa: 2024-12-24T18", "auth_module = login_v2.py", "tokenizer: bert-base-uncased2", "token_count=4096tokens",
    "tokens: 1024abcd", "authors = Miller1999", "password_policy: min12chars", "max_token_length=2048chars", "secret_garden: chapter12a",
]
TRUE = ["password: correct-horse-battery", "k AIza" + "Sy9xQ2mP4kL8vR1tW6zB3nC5dF7gH0jK_aE-Xu"[:35] + " end", "dbPassword = hunter2abc", "client_secret: k9fQ2xZt0Lr2Vn8Yc5Wd", "authToken=Zt0Lr2Vn8Yc5Wd1Kf6Hs"]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")  # the smallest table holds too few


@pytest.fixture(scope="module")
def trees(corpus):
    return secrets.trained(corpus)


def test_names_that_contain_a_credential_word_do_not_make_a_secret(spark, trees, monkeypatch):
    monkeypatch.setattr(secrets, "trained", lambda _: trees)
    out = {r.doc_id: r.text for r in secrets.redact(docs(spark, FALSE + TRUE)).collect()}
    assert [t for i, t in enumerate(FALSE) if out[i] != t] == []
    assert [t for i, t in enumerate(TRUE, len(FALSE)) if "[SECRET]" not in out[i]] == []


def test_findings_of_documents_not_learned_from(corpus, trees):
    rows = secrets.findings(corpus, 10_000, held=True).select("label", (secrets.vote(trees, secrets.features(F.col("candidate"), F.col("before"))) >= secrets.THRESHOLD).alias("said"))
    n = {(r.label, r.said): r["count"] for r in rows.groupBy("label", "said").count().collect()}
    right, wrong, missed = n.get((1, True), 0), n.get((0, True), 0), n.get((1, False), 0)
    assert right >= 1 and n.get((0, False), 0) >= 1, n
    assert right >= 0.95 * (right + wrong) and right >= 0.95 * (right + missed), n


def plain_features(candidate, before):
    low = re.sub("([a-z])([A-Z])", r"\1_\2", before).lower()
    runs = candidate
    for pattern, one in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0-9a-zA-Z]+", "-")):
        runs = re.sub(pattern, one, runs)
    path = re.search(r"([\w.-]*[/.][\w./-]*\w)(?::\d+)?:\s[^\n]*$", low)
    path, n = path[1] if path else "", max(1, len(candidate))
    share = lambda t, drop: len(re.sub(drop, "", t)) / n
    has = lambda words, t: any(w in t for w in words)
    words = "|".join(sorted(secrets.DICTIONARY, key=len, reverse=True))
    credential = "|".join(re.sub("[_-]", "[ _-]?", w) for w in secrets.CREDENTIAL_WORDS)
    given = lambda names: re.search(rf"(?<![a-z])(?:{names}){secrets._ENDS}", low)
    return [
        len(candidate), share(candidate, "[^0-9]+"), share(candidate, "[^A-Z]+"), share(candidate, "[0-9A-Za-z]+"), (len(runs) - 1) / n, len(set(candidate)) / n,
        re.fullmatch("[0-9a-fA-F]+", candidate), re.fullmatch("[0-9 -]+", candidate), re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate),
        re.fullmatch(f"{secrets.KEY_BLOCK}|{'|'.join(secrets.SHAPES)}", candidate, re.ASCII), 1 - share(candidate.lower(), words), len(re.sub("[^/.]+", "", candidate)), re.search(credential, low),
        has(secrets.CHECKSUM_WORDS, low), re.search(r"[=:]>?\s*[\"']?(?i:(?:bearer|basic|token)\s+)?$", before), re.search("[/.@]$", before), has(secrets.CONFIG_PATHS, path), has(secrets.EXAMPLE_PATHS, path),
        re.search(rf"{secrets._ADDRESS}$", before), re.search(r"^[A-Z]?[a-z]+[.,;:!?)]*$|^[A-Z]+[.,;:!?)]*$", candidate), given(credential),
        re.search("^[A-Za-z]+(?:[-_.][A-Za-z]+){2,}$", candidate), given("|".join(secrets.PASSWORD_WORDS)),
    ]


def plain_vote(trees, values):
    def of(tree):
        while not isinstance(tree, float):
            name, threshold, low, high = tree
            tree = low if values[name] <= threshold else high
        return tree

    return sum(map(of, trees)) / len(trees)


def test_features_and_votes_in_plain_python(spark, trees):
    rows = secrets.labelled(600, seed=99)
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, candidate string, before string, label int")
    f = secrets.features(F.col("candidate"), F.col("before"))
    got = {r.i: (r.f, r.v) for r in frame.select("i", f.alias("f"), secrets.vote(trees, f).alias("v")).collect()}
    for i, (candidate, before, _) in enumerate(rows):
        want = [float(bool(x)) if x is None or isinstance(x, re.Match | bool) else float(x) for x in plain_features(candidate, before)]
        assert list(got[i][0]) == pytest.approx(want), (candidate, before)
        assert got[i][1] == pytest.approx(plain_vote(trees, dict(zip(secrets.FEATURES, want, strict=True))))


def test_entropy_and_check_digits(spark):
    texts = ["aaaa", "abab", "abcd", "4111111111111111", "4111111111111112", ""]
    got = [(r.e, r.l) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(secrets.entropy(F.col("t")).alias("e"), secrets._luhn(F.col("t")).alias("l")).collect()]
    assert [e for e, _ in got][:3] == pytest.approx([0.0, 1.0, 2.0]) and [x for _, x in got][3:5] == [True, False]
