"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.llm import chat, lattice, license_scan, mixing, near_dedup, packing, repair, routing, sharding, token_files, toxicity, warc, whitening

REGISTRY, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1
    )


@query("op4_direct_token_codes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_digest(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2
    )


@query("op6_flow_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"), F.array("source"))
    return mixed.select(
        "doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"),
        (F.col("size") * F.col("repeats")).alias("taken"),
    )


@query(
    "op7_warc_boundary_chain",
    """
    WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query(
    "op8_perspective_rotation",
    """
    WITH placed AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
        FROM conversations
    ), speakers AS (
        SELECT DISTINCT conv_id, role AS perspective FROM placed WHERE role <> 'system'
    ), said AS (
        SELECT p.conv_id, s.perspective, p.pos, p.role = s.perspective AS mine,
               replace(replace(p.text, '<|im_start|>', '<|im start|>'), '<|im_end|>', '<|im end|>') || '<|im_end|>' AS body,
               '<|im_start|>' || CASE WHEN p.role = s.perspective THEN 'assistant' WHEN p.role = 'system' THEN 'system'
                   ELSE 'user name=' || replace(replace(p.role, '<|im_start|>', '<|im start|>'), '<|im_end|>', '<|im end|>') END || chr(10) AS lead
        FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
    ), walked AS (
        SELECT *, CAST(floor(pos / 64) AS INTEGER) AS part,
               coalesce(sum(length(lead) + length(body) + 1) OVER (
                   PARTITION BY conv_id, perspective, CAST(floor(pos / 64) AS INTEGER) ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
        FROM said
    )
    SELECT conv_id, perspective, part, CAST(min(pos) AS BIGINT) AS first_turn, CAST(count(*) AS INTEGER) AS n_turns,
           string_agg(lead || body || chr(10), '' ORDER BY pos) AS text,
           coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(begins + length(lead) AS BIGINT) AS VARCHAR) || '-' ||
               CAST(CAST(begins + length(lead) + length(body) AS BIGINT) AS VARCHAR) END, ' ' ORDER BY pos), '') AS masks
    FROM walked GROUP BY conv_id, perspective, part
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    parts = chat.perspectives(table(spark, folder, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return parts.withColumn("masks", F.array_join(spans, " "))


@query("op9_hilbert_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, folder, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "lang", "hilbert",
    )


@query("op5_learned_partitions")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return routing.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


@query(
    "op10_lattice_hashing",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    fit AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
    counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM least LEFT JOIN counts USING (vec_id)
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, folder, "embeddings"), threshold=0.93)


@query("op3_nonnegative_pu")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op1_dart_minhash",
    r"""
    WITH RECURSIVE t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
    w AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[\p{L}\p{N}_]') THEN regexp_extract_all(t, '[\p{L}\p{N}_]+')
          ELSE regexp_extract_all(t, '[^\s]+') END AS ws FROM t),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(1, len(ws) - 4)), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) AS shingle
          FROM w WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * k >= 8 * (na.n + nb.n - k)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY 1
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, folder, "documents"), threshold=0.8).select(
        "doc_id", "class_id", "kept"
    )


@query("op11_incremental_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), components=16)


@query("op12_fuzzy_notices")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_digest(table(spark, folder, "documents")).drop("spans")


def _tied(state: str, keep: str, turn: str, role: str) -> str:
    """SQL: the cheapest, then ASCII-least ending from `state` in front of a turn, before inserts."""
    own = f"{{c: {state}.c + 4, a: 'D' || {state}.a, r: {state}.r}}"
    kept = f", CASE WHEN {keep} THEN {{c: {turn}.c + stays, a: 'K' || {turn}.a, r: line || {turn}.r}} END"
    given = f", {{c: {turn}.c + stays + 3, a: 'R' || {turn}.a, r: '{role}:' || text || chr(10) || {turn}.r}}"
    return f"CASE WHEN gone THEN {own} ELSE list_min([{own}{kept}{given}]) END"


def _inserted(state: str, after: str, role: str) -> str:
    return f"list_min([{state}, {{c: {after}.c + 3, a: 'I' || {after}.a, r: '{role}:' || chr(10) || {after}.r}}])"


@query(
    "op13_survivor_coalescence",
    rf"""
    WITH RECURSIVE bits AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
    ), raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ), drawn AS (
        SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda a, b: xor(t[CAST((xor(a, b) & 255) + 1 AS BIGINT)], a >> 8)), 4294967295) % 20 AS c FROM raw, bits
    ), hurt AS (
        SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) AS copy
        FROM drawn WHERE c <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
    ), marked AS (
        SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini,
               regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
               lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
               role || ':' || text || chr(10) AS line
        FROM placed
    ), faults AS (
        SELECT *, last = '' AS blank, last <> '' AND seen AS dup, last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS cut,
               last = '' OR seen AS gone, CASE WHEN last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS stays
        FROM marked
    ), counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               sum(blank::INT) AS blank, sum(dup::INT) AS duplicate, sum(cut::INT) AS truncated,
               sum((prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au'))::INT) AS illegal
        FROM faults GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, n AS i, {{c: 0::BIGINT, a: '', r: ''}} AS o, {{c: 6::BIGINT, a: 'II', r: 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s,
               {{c: 3::BIGINT, a: 'I', r: 'assistant:' || chr(10)}} AS u, {{c: 0::BIGINT, a: '', r: ''}} AS e FROM counts
        UNION ALL
        SELECT conv_id, i - 1, {_inserted('po', 'nu', 'user')}, {_inserted('ps', 'nu', 'user')}, nu, ne FROM (
            SELECT conv_id, i, po, ps, {_inserted('pu', 'pe', 'assistant')} AS nu, {_inserted('pe', 'pu', 'user')} AS ne FROM (
                SELECT w.conv_id, w.i,
                       CASE WHEN gone THEN {{c: o.c + 4, a: 'D' || o.a, r: o.r}} ELSE list_min([{{c: o.c + 4, a: 'D' || o.a, r: o.r}},
                           CASE WHEN ini = 's' THEN {{c: s.c + stays, a: 'K' || s.a, r: line || s.r}}
                                WHEN ini = 'u' THEN {{c: u.c + stays, a: 'K' || u.a, r: line || u.r}} END,
                           {{c: u.c + stays + 3, a: 'R' || u.a, r: 'user:' || text || chr(10) || u.r}}]) END AS po,
                       {_tied('s', "ini = 'u'", 'u', 'user')} AS ps,
                       {_tied('u', "ini = 'a'", 'e', 'assistant')} AS pu,
                       {_tied('e', "ini = 'u'", 'u', 'user')} AS pe
                FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
            )
        )
    )
    SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(o.c, 0)::BIGINT AS cost,
           coalesce(o.a, '') AS audit, sha256(CASE WHEN coalesce(o.r, '') = '' THEN '' ELSE o.r[:-2] END) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) d
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
    LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.i = 0
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations")
    return repair.repair_report(repair.damaged(said), said)
