"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from . import decontaminate as w
from . import license_scan as lic
from . import quality_rules as q

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_GROWTH = (1 + q.ACCURACY) / (1 - q.ACCURACY)


def _quality_rules() -> str:
    rates = {m: f"({x}) / greatest({n}, 1)" for m, (x, n) in q.MEASURES.items()} | {n: f"{n}::DOUBLE" for n in q.SIZES}
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE 0.0001 * pow({_GROWTH!r}, {b}) * 2 / (1 + {_GROWTH!r}) END"
    levels = []
    for name, cols, part in (("own", "lang, source,", "lang, source, ratio"), ("lang", "lang,", "lang, ratio"), ("every", "", "ratio")):
        quartiles = ", ".join(f"{value(f'min(b) FILTER (upto >= total * {p})')} AS {n}" for n, p in q.QUARTILES.items())
        levels.append(f"""f_{name} AS (SELECT {part}, max(total) AS total, {quartiles} FROM (SELECT {cols} ratio, b, sum(n) OVER (PARTITION BY {part} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {part}) AS total
            FROM (SELECT {part}, b, count(*) AS n FROM each GROUP BY {part}, b)) GROUP BY {part})""")
    drawn = lambda own, wide: ", ".join(f"({own}.total * {own}.{n} + {q.PRIOR} * {wide}.{n}) / ({own}.total + {q.PRIOR}) AS {n}" for n in q.QUARTILES)
    each = " UNION ALL ".join(f"SELECT rn, lang, source, '{k}' AS ratio, {v} AS v FROM c" for k, v in rates.items())
    counted = " UNION ALL ".join(f"SELECT rn, lang, source, '{m}' AS ratio, {x} AS x, {n}::DOUBLE AS n, '{n}' AS size FROM c" for m, (x, n) in q.MEASURES.items())
    return rf"""
    WITH w AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    win AS (SELECT rn, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
    keyed AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, words[i], words[i + 1], words[i + 2]) AS times FROM win),
    rep AS (SELECT rn, count(DISTINCT i + k) AS n FROM (SELECT rn, i, unnest([0, 1, 2]) AS k FROM keyed WHERE times > 1) GROUP BY rn),
    c0 AS (SELECT w.rn, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN rep ON rep.rn = w.rn),
    c AS (SELECT *, (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM c0),
    rate AS ({each}),
    each AS (SELECT r.lang, r.source, r.ratio, CASE WHEN v <= 0.0001 THEN 0 ELSE ceil(ln(v / 0.0001) / ln({_GROWTH!r}))::INT END AS b
        FROM rate r JOIN c ON c.rn = r.rn WHERE NOT base_failed),
    {", ".join(levels)},
    l2 AS (SELECT f_lang.lang, f_lang.ratio, {drawn("f_lang", "f_every")} FROM f_lang JOIN f_every USING (ratio)),
    o2 AS (SELECT f_own.lang, f_own.source, f_own.ratio, l2.hi - l2.mid AS lang_up, f_every.hi - f_every.mid AS every_up, {drawn("f_own", "l2")}
        FROM f_own JOIN l2 ON l2.lang IS NOT DISTINCT FROM f_own.lang AND l2.ratio = f_own.ratio JOIN f_every ON f_every.ratio = f_own.ratio),
    cut AS (SELECT lang, source, ratio, mid, mid + {q.FENCE} * greatest(mid - lo, least(hi - mid, lang_up, every_up)) AS rate FROM o2),
    counted AS ({counted}),
    judged AS (SELECT e.rn, bool_and(coalesce(e.x <= r.rate * n + {q.Z} * sqrt(r.rate * n) + {q.Z} * {q.Z} * greatest(1.0, n / t.mid), true)) AS passes
        FROM counted e LEFT JOIN cut r ON r.lang IS NOT DISTINCT FROM e.lang AND r.source IS NOT DISTINCT FROM e.source AND r.ratio = e.ratio
        LEFT JOIN cut t ON t.lang IS NOT DISTINCT FROM e.lang AND t.source IS NOT DISTINCT FROM e.source AND t.ratio = e.size GROUP BY e.rn)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND passes) AS kept
    FROM c JOIN judged ON judged.rn = c.rn"""


QUALITY_RULES = _quality_rules()

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, {_ALNUM} AS words FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS words FROM benchmark),
    bw AS (SELECT item, least(10, len(words)) AS k, words, unnest(range(0, len(words) - least(10, len(words)) + 1)) AS s FROM b WHERE len(words) > 0),
    grams AS (SELECT DISTINCT item, k, words[s + 1 : s + k] AS w, array_to_string(words[s + 1 : s + k], ' ') AS gram FROM bw),
    ks AS (SELECT DISTINCT k FROM grams),
    dw AS (SELECT rn, words, k, unnest(range(0, len(words) - k + 1)) AS s FROM d, ks WHERE len(words) >= k),
    hits AS (SELECT dw.rn, dw.s, dw.k, g.item FROM dw JOIN grams g ON g.k = dw.k AND g.gram = array_to_string(dw.words[dw.s + 1 : dw.s + dw.k], ' ')),
    cover AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + k)) AS p FROM hits) GROUP BY rn),
    items AS (SELECT rn, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rn),
    post AS MATERIALIZED (SELECT rn, word, p FROM (SELECT rn, unnest(words) AS word, unnest(range(len(words))) AS p FROM d) WHERE word IN (SELECT unnest(words) FROM b)),
    df AS (SELECT word, count(*) AS df FROM post GROUP BY word),
    ranked AS (SELECT item, gram, i, word, coalesce(df.df, 0) AS df, row_number() OVER (PARTITION BY item, gram ORDER BY coalesce(df.df, 0), i) AS r
        FROM (SELECT item, gram, unnest(w) AS word, unnest(range(len(w))) AS i FROM grams) LEFT JOIN df USING (word)),
    rare AS (SELECT x.item, x.gram, x.word AS t1, y.word AS t2, y.i - x.i AS delta FROM ranked x LEFT JOIN ranked y ON y.item = x.item AND y.gram = x.gram AND y.r = 2 WHERE x.r = 1 AND x.df > 0),
    probes AS (SELECT DISTINCT t1, t2, delta FROM rare),
    near AS (SELECT DISTINCT x.rn, t1, t2, delta FROM probes JOIN post x ON x.word = t1 JOIN post y ON y.rn = x.rn AND y.word = t2 AND y.p <> x.p AND y.p BETWEEN x.p + delta - {w.SLOP} AND x.p + delta + {w.SLOP}
        UNION SELECT DISTINCT x.rn, t1, t2, delta FROM probes JOIN post x ON x.word = t1 WHERE t2 IS NULL),
    n AS (SELECT rn, count(DISTINCT item) AS n_near FROM near n JOIN rare r ON r.t1 = n.t1 AND r.t2 IS NOT DISTINCT FROM n.t2 AND r.delta IS NOT DISTINCT FROM n.delta GROUP BY rn)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
        sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
    FROM d LEFT JOIN cover USING (rn) LEFT JOIN items USING (rn) LEFT JOIN n USING (rn)"""


def _license_scan() -> str:
    """An alignment covers enough of a template if it has MIN_COVER of its words in place; posting lists lose none of those."""
    templates = ", ".join(f"({i}, '{label}', ' {key} ', string_split('{notice}', ' '))" for i, (label, key, notice) in enumerate(lic.TEMPLATES))
    base = " UNION ALL ".join(f"SELECT rn, '{label}' AS label, s FROM places WHERE words[s + 1 : s + {len(p.split())}] = string_split('{p}', ' ')" for p, label in lic.BASE.items())
    return rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, {_ALNUM} AS words FROM documents),
    places AS (SELECT rn, words, unnest(range(len(words))) AS s FROM d),
    base AS ({base}),
    t(template, label, key, notice) AS (VALUES {templates}),
    may AS (SELECT rn, words, label, key, notice FROM d JOIN t ON contains(' ' || array_to_string(words, ' ') || ' ', key)),
    aligned AS (SELECT *, unnest(range(1 - len(notice), len(words))) AS s FROM may),
    found AS (SELECT rn, label, len(list_filter(range(len(notice)), lambda i: s + i >= 0 AND words[(s + i + 1)::BIGINT] = notice[i + 1])) / len(notice) AS cover
        FROM aligned WHERE contains(' ' || array_to_string(words[greatest(s, 0) + 1 : greatest(s, 0) + len(notice)], ' ') || ' ', key)),
    lb AS (SELECT rn, label FROM found WHERE cover >= {lic.MIN_COVER} UNION SELECT rn, label FROM base),
    b AS (SELECT rn, count(*) AS n, min(s) AS lo, max(s) AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM base GROUP BY rn),
    f AS (SELECT rn, max(cover) AS cover FROM found WHERE cover >= {lic.MIN_COVER} GROUP BY rn),
    l AS (SELECT rn, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM lb GROUP BY rn)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
        coalesce(f.cover, CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
    FROM d LEFT JOIN b USING (rn) LEFT JOIN f USING (rn) LEFT JOIN l USING (rn)"""


LICENSE_SCAN = _license_scan()

NEAR_DEDUP = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END) AS h
        FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
    sized AS (SELECT doc_id, count(*) AS n, md5(string_agg(h::VARCHAR, ',' ORDER BY h)) AS same FROM s GROUP BY doc_id),
    cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS rep FROM sized),
    reps AS (SELECT s.doc_id, h, n FROM s JOIN cls USING (doc_id) WHERE cls.rep = cls.doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.h = b.h AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
    comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(cls.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, cls.rep, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, cls.rep, d.doc_id) AS kept
    FROM d LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.x = cls.rep"""

#: Bytes as hexadecimal digits, two a byte. A byte is removed if one of the last 100 windows up to it repeats an earlier one.
SUFFIX_DEDUP = r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
    p AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
    e AS (SELECT doc_id, i, sum(CASE WHEN i <= prev + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS prev FROM r)),
    s AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM e GROUP BY doc_id, g),
    k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS begin FROM s),
    c AS (SELECT k.doc_id, count(*)::BIGINT AS n_spans, sum(hi - lo)::BIGINT AS n_removed, string_agg(substr(x, 2 * begin + 1, 2 * (lo - begin)), '' ORDER BY lo) AS head, max(hi) AS tail
        FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Five hexadecimal digits make four base32 digits.
WARC = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f"""

# crc32 is folded over the id's characters, bit by bit; runs are islands of places whose words recur q further on.
RUNS = r"""
    WITH numbered AS (
      SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
    ), hashed AS (
      SELECT *, len(words) AS n,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
      FROM numbered
    ), placed AS (
      SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n END AS a FROM hashed
    ), stretched AS (
      SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed
    ), texts AS (
      SELECT r, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words FROM stretched
    ), w AS (
      SELECT r, n, unnest(words) AS word, unnest(range(n)) AS i FROM texts
    ), equal AS (
      SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ), islands AS (
      SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal) GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)
    ), runs AS (
      SELECT r, start, length, min(q) AS period FROM islands GROUP BY r, start, length
    ), best AS (
      SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
    ), said AS (
      SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY r
    ), gone AS (
      SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
    ), kept AS (
      SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT * FROM w ANTI JOIN gone USING (r, i)) GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length::BIGINT AS length, period, (1000 * length // period)::BIGINT AS exponent_milli,
      sha256(coalesce(said.runs, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
    FROM texts LEFT JOIN best USING (r) LEFT JOIN said USING (r) LEFT JOIN kept USING (r)"""

HARD_NEGATIVES = """
    WITH taking_part AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), one AS (
      SELECT * FROM taking_part QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
    ), scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM one a JOIN one b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id))::INT AS rank, n.other_id AS negative_id, positive_score, n.score AS negative_score
    FROM positives JOIN scored n USING (anchor_id) WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id) <= 5"""
