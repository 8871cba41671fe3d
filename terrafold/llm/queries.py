"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import fold, read
from terrafold.llm.codes import compress, label_errors
from terrafold.llm.decontam import decontaminate
from terrafold.llm.exact import exact_dedup
from terrafold.llm.languages import identify, language_samples
from terrafold.llm.licenses import license_scan
from terrafold.llm.lines import line_dedup
from terrafold.llm.mixing import mix
from terrafold.llm.packing import pack_documents
from terrafold.llm.pii import find_pii
from terrafold.llm.prefixes import conversation_turns, prefix_trie, with_borrowed_heads
from terrafold.llm.simhash import near_duplicates
from terrafold.llm.topk import top_k
from terrafold.llm.toxicity import fit, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_line_dedup",
    f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
     k AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
     s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
     j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> s.first, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
)
def op1_line_dedup(spark, sf):
    out = line_dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_pii")
def op2_pii(spark, sf):
    return find_pii(read(spark, sf, "documents").select("doc_id", "text"))


@query("op3_license_scan")
def op3_license_scan(spark, sf):
    return license_scan(read(spark, sf, "documents").select("doc_id", "text")).drop("spans")


@query(
    "op4_mixing",
    """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
     o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source) AS k FROM w),
     -- with the k - 1 least roomy sources clamped, what is left for the others and their weights
     r AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
     f AS (SELECT k, rest, open FROM r WHERE weight * rest <= cap * open ORDER BY k LIMIT 1),
     t AS (SELECT o.source, o.source_size, CASE WHEN o.k < f.k THEN CAST(o.cap AS DOUBLE)
                  ELSE CAST(o.weight * f.rest AS DOUBLE) / CAST(f.open AS DOUBLE) END AS target FROM o, f),
     p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
     q AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS rest FROM p),
     g AS (SELECT source, doc_id, u, size, count(*) AS n FROM d GROUP BY ALL),
     c AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY u, doc_id NULLS LAST, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM g)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(q.whole * c.size + greatest(0, least(c.size * c.n, q.rest - c.upto)) // c.n AS BIGINT) AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source, range(c.n)
""",
)
def op4_mixing(spark, sf):
    out = mix(read(spark, sf, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op5_top_k",
    """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
     r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op5_top_k(spark, sf):
    return top_k(read(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("op6_simhash")
def op6_simhash(spark, sf):
    out = near_duplicates(read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_language_id")
def op7_language_id(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    samples = language_samples(docs)
    out = identify(docs.select("doc_id", "text", (fold() == 0).alias("held_out")), samples)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query(
    "op8_exact_dedup",
    """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""",
)
def op8_exact_dedup(spark, sf):
    return exact_dedup(read(spark, sf, "documents").select("doc_id", "text"))


@query("op9_packing")
def op9_packing(spark, sf):
    return pack_documents(read(spark, sf, "documents").select("doc_id", "text"))


@query("op10_toxicity")
def op10_toxicity(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf, "labels").select("doc_id", "toxic"))
    out = score_toxicity(docs.select("doc_id", "text", (fold() == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")


_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op11_decontamination",
    f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
     i AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
     v AS (SELECT item, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
     k AS (SELECT DISTINCT n, win FROM v),
     p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
     h AS (SELECT p.rid, p.s, k.n, k.win FROM p JOIN k ON k.n = p.n AND k.win = list_slice(p.w, p.s, p.s + p.n - 1)),
     c AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS place FROM h) GROUP BY rid),
     t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
             (SELECT DISTINCT h.rid, v.item FROM h JOIN v ON v.n = h.n AND v.win = h.win WHERE v.item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
""",
)
def op11_decontamination(spark, sf):
    out = decontaminate(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"), remove=None)
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The rounds of op13 one after the other; ``a0`` to ``a4`` are assignments, ``b0`` to ``b4`` codebooks."""
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
      list_transform(embedding, lambda x: floor({1024} * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT rid, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x
      FROM k, range({parts}) r(part)),
    b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
      SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM p JOIN b{i} b USING (part)) GROUP BY rid, part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, list(y ORDER BY pos) AS x FROM (
      SELECT part, entry, pos, floor(sum(c) / count(*)) AS y FROM (
        SELECT a.part, a.entry, unnest(p.x) AS c, generate_subscripts(p.x, 1) AS pos FROM a{i} a JOIN p USING (rid, part)) GROUP BY ALL) GROUP BY ALL),
    b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
    e AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
    l AS (SELECT k.label, CAST(sum(e.error) AS BIGINT) AS label_error FROM k JOIN e USING (rid) GROUP BY k.label),
    s AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
          FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM b{rounds}))
    SELECT k.vec_id, e.code, e.error, l.label_error, s.codebooks_sha256
    FROM k JOIN e USING (rid) JOIN l ON l.label IS NOT DISTINCT FROM k.label, s"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark, sf):
    out = label_errors(compress(read(spark, sf, "embeddings").select("vec_id", "embedding", "label")).rows)
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    return out.select("vec_id", digits, "error", "label_error", "codebooks_sha256")


# crc32 of the digits of an id, bit by bit: each byte, then eight steps, in one list.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""


@query(
    "op12_prefix_trie",
    f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) - 1 AS pos,
             md5(length(r) || ':' || r || x) AS k, strlen(x) AS size
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
     i AS (SELECT c, c - c % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
     b AS (SELECT i.c, 0 AS own, t.pos, t.k, t.size FROM i JOIN t ON t.conv_id = i.base AND t.pos < i.h
           UNION ALL SELECT i.c, 1, t.pos, t.k, t.size FROM i JOIN t ON t.conv_id = i.c AND t.pos >= i.h),
     s AS (SELECT i.c, coalesce(list(b.k ORDER BY b.own, b.pos) FILTER (b.k IS NOT NULL), []) AS ks,
             coalesce(list(b.size ORDER BY b.own, b.pos) FILTER (b.k IS NOT NULL), []) AS sizes FROM i LEFT JOIN b ON b.c = i.c GROUP BY i.c),
     m AS MATERIALIZED (SELECT c, len(ks) AS n, d AS depth, array_to_string(list_slice(ks, 1, d), '') AS p,
             CASE WHEN d > 0 THEN array_to_string(list_slice(ks, 1, d - 1), '') END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
           FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
     n AS MATERIALIZED (SELECT p, any_value(up) AS up, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
             (count(*) - 1) * any_value(size) AS own_saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
           FROM m GROUP BY p),
     k AS (SELECT up AS p, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
     a AS (SELECT left(n.p, CAST(32 * d AS BIGINT)) AS p, count(*) FILTER (k.p IS NULL) AS n_leaves, sum(n.own_saved) AS saved
           FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) n LEFT JOIN k ON k.p = n.p GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a ON a.p = n.p LEFT JOIN k ON k.p = n.p LEFT JOIN n u ON u.p = n.up
""",
)
def op12_prefix_trie(spark, sf):
    turns, ids = with_borrowed_heads(conversation_turns(read(spark, sf, "conversations")))
    out = prefix_trie(turns, ids)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )
