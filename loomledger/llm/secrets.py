"""Secret scans: patterns propose candidates, a random forest removes false findings.

Candidates are private-key blocks, passwords in addresses, tokens that follow a
known shape, and values given to a name that contains a credential word. The forest sees each candidate's length, character classes and
transitions, the share of it that dictionary words cover, the file path named
before it, and the words beside it: credential and checksum words, and whether the
name that a value is given to ends in a credential word (`db_password`) or merely
contains one (`author`, `token_count`). It is trained here, from two kinds of
labelled findings. FINDINGS of them, the first by a hash, are proposed in
DOCUMENTS of the scanned documents that are not held out, and labelled by rules that are no
features: a value of much entropy given to a credential is a secret; numbers with
a card's check digit and what no credential word stands near are not. LABELLED
come from a seeded generator, in the shapes of secrets and of what passes for
them (checksums, ids, placeholders, paths, other names), since documents may
hold few. The trees then become one SQL expression, so that scoring is built-in
functions.

Every part of the pattern either starts where a run of its characters starts or
takes runs whole (possessively), so that its time is linear in a text's length.

Defined cases: null and empty texts have no findings; repeated rows are scanned
each; overlapping candidates are kept apart by start, the longest match of the
one pattern at a place; an empty table gives an empty result; extra columns are
kept by redact() and ignored by scan(), whatever their names; texts of any
length are scanned whole.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, written

LABELLED = 6000
FINDINGS = 2000
#: Documents that findings are taken from, the first by a hash of their ids.
DOCUMENTS = 4000
#: Bits a character from which a value given to a credential is taken for a secret when findings are labelled.
ENTROPY = 3.0
TREES = 25
DEPTH = 7
SEED = 7
THRESHOLD = 0.5
#: Characters before a candidate that count as its neighbourhood.
BEFORE = 80

#: Words that stand beside secrets, and beside what merely looks like one; dictionary words of placeholders and identifiers.
CREDENTIAL_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "bearer", "private_key", "authorization", "passphrase"]
CHECKSUM_WORDS = ["sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "hash", "etag", "uuid", "guid", "integrity", "build"]
DICTIONARY = [
    "about", "access", "account", "action", "admin", "after", "alpha", "application", "archive", "array", "asset", "author", "backup", "base", "before", "beta", "branch", "bucket", "build", "button",
    "cache", "changeme", "channel", "class", "client", "cloud", "code", "column", "common", "config", "connection", "content", "context", "control", "core", "count", "create", "custom", "data", "database",
    "date", "default", "delete", "demo", "deploy", "design", "detail", "device", "display", "document", "download", "driver", "dummy", "element", "email", "engine", "entry", "error", "event", "example",
    "export", "feature", "field", "file", "filter", "final", "first", "folder", "form", "format", "frame", "from", "function", "group", "handler", "header", "hello", "home", "host", "image",
    "import", "index", "info", "input", "insert", "instance", "internal", "item", "label", "last", "layout", "level", "library", "limit", "line", "link", "list", "local", "location", "login",
    "main", "manager", "master", "member", "menu", "message", "method", "model", "module", "name", "network", "node", "none", "null", "number", "object", "option", "order", "output", "package",
    "page", "parent", "parse", "password", "path", "pattern", "place", "placeholder", "plugin", "policy", "process", "product", "profile", "project", "property", "public", "query", "queue", "read", "record",
    "release", "remote", "report", "request", "required", "resource", "response", "result", "sample", "schema", "script", "search", "secret", "select", "server", "service", "session", "setting", "simple", "source",
    "static", "status", "storage", "string", "style", "system", "table", "target", "task", "temp", "template", "test", "text", "time", "title", "token", "type", "update", "upload", "user",
    "value", "version", "video", "view", "window", "word", "work", "world", "write", "your",
]
#: Parts of a path that speak for a real configuration, and for a file of examples.
CONFIG_PATHS = ["config", "settings", "secrets", "credentials", "deploy", "prod", ".env", ".pem", ".tfvars", ".ini", ".yml", ".yaml", ".properties", ".npmrc", "id_rsa"]
EXAMPLE_PATHS = ["test", "spec", "fixture", "example", "sample", "mock", "demo", "docs", "readme", "node_modules", "vendor", ".lock", ".min.js", ".md"]
#: Candidate shapes, tried in this order at each place.
SHAPES = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{36}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}",
    r"sk_live_[0-9A-Za-z]{16,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+",
]
#: A private-key block; if it is cut off, its long lines.
_KEY_NAME = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
KEY_BLOCK = rf"-----BEGIN {_KEY_NAME}(?:(?:[^-]++|-(?!----))*+-----END {_KEY_NAME}|(?:\s++[A-Za-z0-9+/]{{32,}}+={{0,2}})++)"
#: A credential word, written with '_', '-', a blank or nothing between its parts.
_CREDENTIAL = "|".join(dict.fromkeys(re.sub("[_-]", "[ _-]?", w) for w in CREDENTIAL_WORDS))
#: A whole name; a blank belongs to it only between the parts of a credential word.
_BLANKS = "|".join(sorted({rf"(?<={a}) (?={b})" for a, b in (re.split("[_-]", w) for w in CREDENTIAL_WORDS if re.search("[_-]", w))}))
_NAME = rf"(?:[a-z0-9+/_-]++|{_BLANKS})++"
#: What stands before a value: a name that contains a credential word, a mark of assignment and perhaps an authentication scheme.
_HEAD = rf"(?i:(?=[a-z0-9+/_-]*?(?:{_CREDENTIAL})){_NAME}[\"']?\]?\s*+(?:=>|:=|[=:])\s*+[\"']?(?:(?:bearer|basic|token)\s++)?)"
#: What stands before the password of an address.
_ADDRESS = r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++://[^\s/:@\"']*+:"
_EDGE = r"(?<![A-Za-z0-9+/_-])"
#: Everything proposed: a key block, an address's password, a value given to a credential name, or a token of a known shape; the plain shape needs a digit and starts where its run of characters does.
PROPOSE = rf"{_EDGE}(?:{KEY_BLOCK}|{_ADDRESS}[^\s/@\"']++(?=@)|{_HEAD}[^\s\"']{{6,}}+|{'|'.join(SHAPES)}|(?<!=)(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{16,}}+)"
FEATURES = ["length", "digits", "uppers", "symbols", "transitions", "distinct", "hex", "numeric", "uuid", "known", "dictionary", "slashes", "credential", "checksum", "assigned", "in_path", "config_path", "example_path", "address", "letters", "named", "phrase", "password_name"]
#: Names whose values people choose as words, and words that stand inside or before a credential word without naming one.
PASSWORD_WORDS = ["password", "passwd", "pwd", "passphrase"]
OTHER_NAMES = ["author", "authority", "authentic", "authored", "secretary", "secretariat", "tokenizer", "tokenized", "tokens", "passworded", "bearers", "credentialed"]
#: Behind a credential word that ends a name: what may follow, and the assignment.
_ENDS = r"(?:[_-]?(?:key|value|[0-9]+))*[\"']?\]?\s*(?:=>|:=|[=:])\s*[\"']?(?:(?:bearer|basic|token)\s+)?$"
#: A file named on the candidate's line before it, up to its line number.
_PATH = r"([\w.-]*[/.][\w./-]*\w)(?::\d+)?:\s[^\n]*$"


def _share(text: Column, drop: str) -> Column:
    """Share of the characters left when those that the pattern matches go."""
    return F.length(F.regexp_replace(text, drop, "")) / F.greatest(F.length(text), F.lit(1))


def features(candidate: Column, before: Column) -> Column:
    """A struct of FEATURES, all doubles, from built-in functions."""
    runs = candidate
    for pattern, one in ((r"[0-9]+", "0"), (r"[a-z]+", "a"), (r"[A-Z]+", "A"), (r"[^0-9a-zA-Z]+", "-")):
        runs = F.regexp_replace(runs, pattern, one)
    low = F.lower(F.regexp_replace(before, "([a-z])([A-Z])", "$1_$2"))
    path = F.regexp_extract(low, _PATH, 1)
    n = F.greatest(F.length(candidate), F.lit(1))
    yes = lambda c: c.cast("double")
    values = [
        F.length(candidate),
        _share(candidate, r"[^0-9]+"),
        _share(candidate, r"[^A-Z]+"),
        _share(candidate, r"[0-9A-Za-z]+"),
        (F.length(runs) - 1) / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        yes(candidate.rlike(r"^[0-9a-fA-F]+$")),
        yes(candidate.rlike(r"^[0-9 -]+$")),
        yes(candidate.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        yes(candidate.rlike(rf"^(?:{KEY_BLOCK}|{'|'.join(SHAPES)})$")),
        1 - _share(F.lower(candidate), "|".join(sorted(DICTIONARY, key=len, reverse=True))),
        F.length(F.regexp_replace(candidate, "[^/.]+", "")),
        yes(low.rlike(_CREDENTIAL)),
        yes(low.rlike("|".join(CHECKSUM_WORDS))),
        yes(before.rlike(r"[=:]>?\s*[\"']?(?i:(?:bearer|basic|token)\s+)?$")),
        yes(before.rlike(r"[/.@]$")),
        yes(path.rlike("|".join(map(re.escape, CONFIG_PATHS)))),
        yes(path.rlike("|".join(map(re.escape, EXAMPLE_PATHS)))),
        yes(before.rlike(rf"{_ADDRESS}$")),
        yes(candidate.rlike(r"^[A-Z]?[a-z]+[.,;:!?)]*$|^[A-Z]+[.,;:!?)]*$")),
        yes(low.rlike(rf"(?<![a-z])(?:{_CREDENTIAL}){_ENDS}")),
        yes(candidate.rlike(r"^[A-Za-z]+(?:[-_.][A-Za-z]+){2,}$")),
        yes(low.rlike(rf"(?<![a-z])(?:{'|'.join(PASSWORD_WORDS)}){_ENDS}")),
    ]
    return F.struct(*[v.cast("double").alias(name) for name, v in zip(FEATURES, values, strict=True)])


def labelled(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(candidate, before, label): seeded findings in the common shapes of secrets (1) and of what passes for them (0)."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(r.choices(chars, k=k))
    words = lambda: " ".join(draw("abcdefghinorstuw", r.randint(2, 8)) for _ in range(5)) + " "
    file = lambda parts: "/".join(r.choices(DICTIONARY, k=r.randint(0, 2)) + [r.choice(DICTIONARY) + r.choice(parts)]) + r.choice(["", ":" + draw("123456789", 2)]) + ": "
    prose = lambda: words() if r.random() < 0.8 else file(CONFIG_PATHS + EXAMPLE_PATHS + [".py", ".c"])
    assign = lambda word: prose() + name(word) + r.choice(["=", " = ", ": ", '="', " = \"", ":", '": "', "': '", " => ", " := "])
    name = lambda word: r.choice(["", "", "", "db_", "client_", "MY-"]) + r.choice([word, word, word.upper()]) + r.choice(["", "", "", "_1", "_value"])
    address = lambda: prose() + r.choice(["postgres", "https", "redis", "amqp", "mongodb+srv", "ftp"]) + "://" + r.choice(["", draw("abcdefghinorstuw", 5), r.choice(DICTIONARY)]) + ":"
    lower = "abcdefghijklmnopqrstuvwxyz"
    mixed = lambda chars, k: "".join(r.sample(draw(chars, k - 2) + r.choice("0123456789") + r.choice("!@#$%^&*?~"), k))
    capital = lambda k: draw(lower, k).capitalize()
    file_name = lambda: f"{r.choice(DICTIONARY)}_v{r.randint(1, 9)}.{r.choice(['py', 'js', 'json', 'txt'])}"
    value = lambda: r.choice([capital(r.randint(3, 8)) + draw("0123456789", 4) + r.choice(["", "x"]), "-".join((draw("12", 1) + draw("0123456789", 3), "1" + draw("012", 1), "2" + draw("0123456789", 1))) + r.choice(["", "T1" + draw("0123456789", 1)]), file_name(), draw("123456789", 4) + draw(lower, r.randint(2, 7)), r.choice(DICTIONARY) + "-" + draw(lower, 5) + "-" + draw(lower, 4) + draw("0123456789", 1), draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3) + draw("0123456789", 5) + r.choice(["", "x"]), draw(alnum, r.randint(8, 24))])
    other = lambda: r.choice([r.choice(OTHER_NAMES), r.choice(CREDENTIAL_WORDS) + r.choice("_-") + r.choice([*DICTIONARY, draw(lower, 5)])])
    gives = lambda: r.choice(["=", " = ", ": ", '="', ":", " := "])
    kinds = [
        lambda: (value(), prose() + r.choice(["", "", "my_", "x-"]) + other() + gives(), 0),
        lambda: (value(), prose() + r.choice(["", "", "my_", "x-"]) + other() + gives(), 0),
        lambda: (r.choice("-_.").join(r.choice([draw(lower, r.randint(3, 8)), r.choice(DICTIONARY)]) for _ in range(r.randint(3, 5))), assign(r.choice(PASSWORD_WORDS)), 1),
        lambda: (r.choice("-_.").join(r.choice([draw(lower, r.randint(3, 8)), r.choice(DICTIONARY)]) for _ in range(r.randint(3, 5))), prose() + r.choice([other(), r.choice(DICTIONARY)]) + gives(), 0),
        lambda: ("AIza" + draw(alnum + "_-", 35), prose(), 1),
        lambda: (draw(hexa, r.randint(12, 40)), assign(r.choice(CREDENTIAL_WORDS)), 1),
        lambda: (draw(alnum, r.randint(12, 48)), assign(r.choice(CREDENTIAL_WORDS)), 1),
        lambda: (draw(alnum, r.randint(8, 14)) + r.choice("!@#$%"), assign(r.choice(["password", "passwd", "pwd"])), 1),
        lambda: (draw(lower, r.randint(4, 10)) + draw("0123456789", r.randint(1, 4)) + draw(lower, r.randint(0, 4)) + r.choice(["", "", "!", "#"]), assign(r.choice(CREDENTIAL_WORDS)), 1),
        lambda: (mixed(r.choice([alnum, lower]), r.randint(8, 16)), assign(r.choice(CREDENTIAL_WORDS)), 1),
        lambda: (draw(alnum, r.randint(0, 4)) + r.choice("!@#$%^&*?") + r.choice(DICTIONARY) + draw("0123456789", r.randint(1, 3)) + r.choice(["", "!", "#"]), assign(r.choice(CREDENTIAL_WORDS)), 1),
        lambda: (r.choice([mixed(alnum, r.randint(8, 16)), draw(alnum, r.randint(6, 24)), draw(lower, r.randint(4, 10)) + draw("0123456789", r.randint(1, 4)), draw(lower, r.randint(4, 14))]), address(), 1),
        lambda: (f"-----BEGIN {(k := r.choice(['', 'RSA ', 'EC ', 'OPENSSH ']))}PRIVATE KEY-----\n" + "\n".join(draw(alnum + "+/", 64) for _ in range(r.randint(1, 26))) + f"\n-----END {k}PRIVATE KEY-----", prose(), 1),
        lambda: ("AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), prose(), 1),
        lambda: ("gh" + r.choice("pousr") + "_" + draw(alnum, 36), prose(), 1),
        lambda: ("sk_live_" + draw(alnum, r.randint(20, 32)), prose(), 1),
        lambda: ("eyJ" + draw(alnum, 18) + "." + draw(alnum, 30) + "." + draw(alnum + "_-", 30), prose() + r.choice(["", "bearer "]), 1),
        lambda: (draw(hexa, r.choice([32, 40, 64])), assign(r.choice(CHECKSUM_WORDS)) if r.random() < 0.7 else prose() + r.choice(CHECKSUM_WORDS) + " ", 0),
        lambda: (draw(hexa, r.choice([32, 40, 64])), prose(), 0),
        lambda: ("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), prose(), 0),
        lambda: (draw("0123456789", r.randint(16, 24)), prose(), 0),
        lambda: (r.choice("-_").join(r.choices(DICTIONARY, k=r.randint(3, 5))) + draw("0123456789", r.randint(1, 3)), prose(), 0),
        lambda: ("/".join([*r.choices(DICTIONARY, k=r.randint(3, 5)), "v" + draw("0123456789", 1)]), prose() + r.choice(["/", "./", ""]), 0),
        lambda: (r.choice(["your", "my", "example", "changeme", "dummy"]) + r.choice("-_") + r.choice(DICTIONARY) + r.choice(["", "1", "123"]), assign(r.choice(CREDENTIAL_WORDS)), 0),
        lambda: (r.choice([draw(lower, r.randint(6, 12)), draw(lower, r.randint(6, 12)).capitalize(), draw(lower, r.randint(6, 12)).upper()]) + r.choice(["", "", ",", "."]), assign(r.choice([*CREDENTIAL_WORDS, "author", "authority", "secretary", "tokens"])), 0),
        lambda: (r.choice([*DICTIONARY, "changeme", "xxxxxx", "******"]), address(), 0),
        lambda: ("<" + r.choice(["", "your-"]) + r.choice(DICTIONARY) + ">", assign(r.choice(CREDENTIAL_WORDS)), 0),
        lambda: (r.choice(["${", "{{", "$("]) + "_".join(r.choices(DICTIONARY, k=2)).upper() + "}", assign(r.choice(CREDENTIAL_WORDS)), 0),
        lambda: (r.choice(["x", "*", "0"]) * r.randint(8, 24), assign(r.choice(CREDENTIAL_WORDS)), 0),
        lambda: (draw("abcdefghinorstuw", r.randint(16, 22)) + draw("0123456789", r.randint(1, 2)), prose(), 0),
        lambda: (draw(alnum, r.randint(20, 44)), file(CONFIG_PATHS) + name(r.choice(CREDENTIAL_WORDS)) + " = ", 1),
        lambda: (draw(alnum, r.randint(20, 44)), file(EXAMPLE_PATHS), 0),
    ]
    return [r.choice(kinds)() for _ in range(n)]


def _luhn(digits: Column) -> Column:
    """Whether a text of digits has a card's check digit."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.when(c.try_cast("int") > 4, 2 * c.try_cast("int") - 9).otherwise(2 * c.try_cast("int"))))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0, F.lit(False))


def entropy(text: Column) -> Column:
    """Bits a character, by how often each stands in the text."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(each).cast("double")
    parts = F.transform(F.array_distinct(each), lambda c: F.size(F.filter(each, lambda x: x == c)).cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))


def findings(docs: DataFrame, most: int = FINDINGS, held: bool = False) -> DataFrame:
    """(candidate, before, label): what documents hold, where a rule tells; of documents that are held out, or of the others."""
    chosen = docs.filter(held_out(F.col("doc_id")) == F.lit(held)).select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("text")  # at most DOCUMENTS ids
    found = _proposed(rows).filter("matched is not null").select(F.explode("parts").alias("p")).select("p.candidate", "p.before").distinct()
    found = found.orderBy(F.xxhash64("candidate", "before"), "candidate", "before").limit(most)  # the bound of what is learned from
    given = F.lower("before").rlike(rf"(?<![a-z])(?:{_CREDENTIAL}){_ENDS}")
    plain = F.col("candidate").rlike("^[0-9]+$") & _luhn(F.col("candidate"))
    label = F.when(plain | ~F.lower("before").rlike(_CREDENTIAL), 0).when(given & (entropy(F.col("candidate")) >= ENTROPY) & F.col("candidate").rlike("[0-9]"), 1)
    known = F.col("candidate").rlike(rf"^(?:{KEY_BLOCK}|{'|'.join(SHAPES)})$") | F.col("before").rlike(rf"{_ADDRESS}$")
    return found.filter(~known).withColumn("label", label).filter("label is not null")


def trained(docs: DataFrame) -> list[list]:
    """The forest's trees as nested [feature, threshold, low branch, high branch] or a leaf's label."""
    rows = docs.sparkSession.createDataFrame(labelled(), "candidate string, before string, label int").unionByName(findings(docs)).coalesce(1).sortWithinPartitions("candidate", "before", "label")
    rows = rows.select(features(F.col("candidate"), F.col("before")).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    rows = written(rows, "secret_findings")  # learning reads them many times
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.6").fit(rows)
    return [_branch(tree._call_java("rootNode")) for tree in model.trees]


def _branch(node) -> list | float:
    """A tree's node as nested lists, down to the leaves' labels."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return [FEATURES[split.featureIndex()], float(split.threshold()), _branch(node.leftChild()), _branch(node.rightChild())]


def vote(trees: list, f: Column) -> Column:
    """Share of the trees that call it a secret."""

    def of(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        name, threshold, low, high = tree
        return F.when(f[name] <= threshold, of(low)).otherwise(of(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + of(tree)
    return total / len(trees)


def _proposed(docs: DataFrame) -> DataFrame:
    """Per row: `row` with all of docs' columns, `text`, `matched` (null: nothing proposed), `between` and `parts` (candidate, head, before): the text is between[0] + head + candidate + between[1] + ..."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    has = F.coalesce(F.col("text").rlike(PROPOSE), F.lit(False))
    rows = rows.select("row", "text", F.when(has, F.regexp_extract_all("text", F.lit(f"({PROPOSE})"), F.lit(1))).alias("matched"), F.when(has, F.split("text", PROPOSE)).alias("between"))
    head = lambda m: F.regexp_extract(m, f"^({_ADDRESS}|{_HEAD})", 1)
    # zipped outside of the lambda, in which the text would be split anew for every candidate
    found = F.filter(F.arrays_zip("matched", "between"), lambda z: z["matched"].isNotNull())
    parts = F.transform(found, lambda z: F.struct(z["matched"].alias("whole"), head(z["matched"]).alias("head"), z["between"].alias("gap")))
    parts = F.transform(parts, lambda p: F.struct(F.substring(p["whole"], F.length(p["head"]) + 1, F.length(p["whole"])).alias("candidate"), p["head"].alias("head"), F.concat(F.right(p["gap"], F.lit(BEFORE)), p["head"]).alias("before")))
    return rows.withColumn("parts", parts)


def _scored(docs: DataFrame, trees: list) -> DataFrame:
    """Proposed rows, each part with its score."""
    rows = _proposed(docs).withColumn("parts", F.transform("parts", lambda p: F.struct(p["candidate"].alias("candidate"), p["head"].alias("head"), features(p["candidate"], p["before"]).alias("f"))))
    return rows.withColumn("parts", F.transform("parts", lambda p: F.struct(p["candidate"].alias("candidate"), p["head"].alias("head"), vote(trees, p["f"]).alias("score"))))


def scan(docs: DataFrame) -> DataFrame:
    """Per candidate: doc_id, start and end (characters from 0), secret_sha256, score, is_secret."""
    rows = _scored(docs.select("doc_id", "text"), trained(docs)).filter("matched is not null")
    gaps = F.slice("between", F.lit(1), F.size("matched"))
    # running ends of the pieces before each candidate, per row, without another shuffle
    sizes = F.zip_with(gaps, "parts", lambda g, p: F.struct((F.length(g) + F.length(p["head"])).alias("ahead"), F.length(p["candidate"]).alias("own"), p.alias("p")))
    placed = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,candidate:string,score:double>>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["ahead"] + x["own"]).alias("at"), F.array_append(s["out"], F.struct((s["at"] + x["ahead"]).alias("start"), (s["at"] + x["ahead"] + x["own"]).alias("end"), x["p"]["candidate"].alias("candidate"), x["p"]["score"].alias("score"))).alias("out")),
        lambda s: s["out"],
    )
    each = rows.select(F.col("row.doc_id").alias("doc_id"), F.explode(placed).alias("x"))
    return each.select(
        "doc_id",
        F.col("x.start").cast("long").alias("start"),
        F.col("x.end").cast("long").alias("end"),
        F.sha2("x.candidate", 256).alias("secret_sha256"),
        F.col("x.score").alias("score"),
        (F.col("x.score") >= THRESHOLD).alias("is_secret"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret's characters replaced; all rows and columns stay. n_chars, if there is one, follows the text."""
    rows = _scored(docs, trained(docs))
    pieces = F.transform("parts", lambda p, i: F.concat(F.get("between", i), p["head"], F.when(p["score"] >= THRESHOLD, F.lit(mark)).otherwise(p["candidate"])))
    clean = F.when(F.col("matched").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), F.element_at("between", -1)))
    rows = rows.select("row", "matched", clean.alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("matched").isNull(), F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
