"""The registered queries of the operators, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if check:
            CHECKS[fn.__name__] = check
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all documents in length buckets and token-budget batches."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query(
    f"""
    WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    from .exact import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the learned decision list on all documents."""
    from .quality import fit, judge

    docs = _table(spark, sf_dir, "documents")
    rules = fit(docs, _table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        "_row.doc_id",
        *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", "rule",
    )


@query()
def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over all documents."""
    from .minhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


@query()
def op3_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the merge automaton, and their decoding."""
    import public_tokenizers

    from .bpe import Codec

    codec = Codec(spark, public_tokenizers.path("word_bpe_49k.json"))
    return codec.encoded(_table(spark, sf_dir, "documents"), decode=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_ASIDE = "</s>[INST] ok [/INST]"


@query(
    rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_ASIDE}' UNION ALL SELECT -7, 1, 'assistant', '{_ASIDE}'
    ), spelt AS (
      SELECT *,
        length(regexp_replace(text, '([<\[])(\\*)(INST\]|/INST\]|s>|/s>)', '\1\\\2\3', 'g')) AS text_chars,
        length(regexp_replace(role, '([<\[])(\\*)(INST\]|/INST\]|s>|/s>)', '\1\\\2\3', 'g')) AS role_chars,
        coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS same
      FROM turns
    ), told AS (
      SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(text_chars + CASE WHEN same THEN 3 ELSE 17 + role_chars END)::BIGINT AS formatted_chars
      FROM spelt GROUP BY conv_id
    )
    SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
    FROM told
    """
)
def op2_chat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted text."""
    from .chat import format_conversations, read_back, under_mask

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    aside = spark.createDataFrame([(-7, 0, "user", _ASIDE), (-7, 1, "assistant", _ASIDE)], "conv_id bigint, turn bigint, role string, text string")
    out = format_conversations(rows.unionByName(aside)).select(
        "conv_id", "formatted", read_back("formatted").alias("turns"), under_mask("formatted", "mask").alias("loss")
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: Rules of the url query: host, path, verdict.
_URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def _shrink_sql(units: str, keys: str) -> str:
    p = "least(greatest(prior, 1e-6), 1 - 1e-6)"
    return f"""SELECT u.*, (prior * w + good) / (w + n) AS rate, n + w AS strength FROM {units} u, (
      SELECT 1.0::DOUBLE / least(greatest(coalesce((sum((good - n * {p}) ** 2 / ({p} * (1 - {p}))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.5) - 1 AS w
      FROM {units})"""


@query(
    rf"""
    WITH parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
    ), votes AS (
      SELECT doc_id, count(*) AS n, sum((quality = 1 AND toxic = 0)::BIGINT) AS good FROM labels
      WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
    ), hosts AS (
      SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
        coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good
      FROM parts LEFT JOIN votes ON doc_id = page_id GROUP BY ALL
    ), s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT sum(good) / sum(n) FROM hosts) AS prior FROM hosts GROUP BY suffix),
    s1 AS ({_shrink_sql("s0", "suffix")}),
    d0 AS (SELECT domain, hosts.suffix, sum(hosts.n) AS n, sum(hosts.good) AS good, any_value(rate) AS prior FROM hosts JOIN s1 USING (suffix) GROUP BY ALL),
    d1 AS ({_shrink_sql("d0", "domain")}),
    h0 AS (SELECT host, hosts.n, hosts.good, rate AS prior FROM hosts JOIN d1 USING (domain, suffix)),
    h1 AS ({_shrink_sql("h0", "host")}),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, _URL_RULES))}),
    fits AS (
      SELECT DISTINCT host, path, first_value(rule_host || rule_path) OVER w AS rule, first_value(rule_verdict) OVER w AS ruled
      FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      WINDOW w AS (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC)
    )
    SELECT page_id, host, path, rule,
      coalesce(ruled, CASE WHEN rate + 1.645 * sqrt(rate * (1 - rate) / (strength + 1)) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
    FROM parts JOIN h1 USING (host) LEFT JOIN fits USING (host, path)
    """
)
def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages.  A page is good whose label of the same id says
    quality 1 and toxic 0."""
    from .hosts import judge_urls

    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    rules = spark.createDataFrame(_URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), outcomes, rules).select("page_id", "host", "path", "rule", "verdict")


@query(
    """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f
    """
)
def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, read back and assembled."""
    from .common import scratch, staged
    from .warc import assemble, captures_of, field_of, read_records, write_captures

    path = scratch(spark, "warc")
    write_captures(captures_of(_table(spark, sf_dir, "pages")), path)
    # unpacked and hashed once; assembling reads the slim records several times
    records = staged(read_records(spark, path).withColumn("fields", F.when(F.col("type") == "metadata", F.col("block"))).drop("block", "payload"), "warc-records")
    pages = staged(
        assemble(records).select(
            "uri", field_of(F.get("metadata", F.lit(0))["fields"], "page_id").cast("bigint").alias("page_id"),
            F.col("head.type").alias("record_type"), F.col("head.refers_to").alias("first_uri"),
            F.col("head.payload_bytes").alias("bytes"), F.col("head.payload_digest").alias("digest"),
        ),
        "warc-pages",
    )
    firsts = pages.filter("record_type = 'response'").select(
        F.col("uri").alias("first_uri"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")
    ).dropDuplicates(["first_uri"])
    revisits = pages.filter("first_uri IS NOT NULL").select("page_id", "record_type", "first_uri").join(firsts, "first_uri", "left").drop("first_uri")
    own = pages.filter("first_uri IS NULL").select(
        "page_id", "record_type", F.lit(None).cast("bigint").alias("refers_to"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")
    )
    return revisits.unionByName(own).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _licence_sql() -> str:
    from . import licences as L

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    broken = "lower(coalesce(text, ''))"
    for pattern, by in L.BREAKS:
        broken = f"regexp_replace({broken}, {quoted(pattern)}, {quoted(by)}, 'g')"
    clean = "s"
    for pattern, by in L.STEPS:
        clean = f"regexp_replace({clean}, {quoted(pattern)}, {quoted(by)}, 'g')"
    told = "told"
    for licence, wanted in L.rules():
        told = f"replace({told}, {quoted(''.join(f'<{i}>' for i in wanted))}, {quoted('{' + licence + '}')})"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in L.sentence_ids().items())
    return f"""
    WITH cut AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split({broken}, '\x01') AS parts FROM documents)),
    found AS (SELECT doc_id, pos, id FROM (SELECT doc_id, pos, {clean} AS s FROM cut WHERE regexp_matches(s, '[a-z]')) LEFT JOIN (VALUES {known}) k(sentence, id) ON s = sentence),
    seq AS (
      SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY pos), '') AS sentence_ids,
        string_agg(CASE WHEN id IS NULL THEN '_' ELSE '<' || id || '>' END, '' ORDER BY pos) AS told
      FROM found GROUP BY doc_id
    ), ruled AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce({told}, '') AS told FROM documents LEFT JOIN seq USING (doc_id))
    SELECT doc_id, sentence_ids, array_to_string(regexp_extract_all(told, '\\{{([^}}]*)\\}}', 1), ',') AS licences,
      len(regexp_extract_all(told, '<([^>]*)>', 1)) AS n_unmatched
    FROM ruled
    """


@query(_licence_sql())
def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of all documents."""
    from .licences import scan

    return scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"),
        F.col("n_unmatched").cast("bigint").alias("n_unmatched"),
    )


@query()
def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, learned from those not held out."""
    import public_tokenizers

    from .lattice import is_held_out, load_pieces, score_texts

    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return score_texts(_table(spark, sf_dir, "documents"), pieces, is_held_out("doc_id"))


def _manifest_sql(levels: int = 8) -> str:
    """Level by level up to 8 ** levels rows of a group; crc32 over the ten digits bit by bit."""
    def enc(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def level(nodes: str, k: int) -> str:
        """The nodes over a level; a group with a single node keeps it."""
        return f"""SELECT g, no // 8 AS no, any_value(n) > 1 AS hashed, [{'{'}'no': 0, 'd': ''{'}'}] || list({'{'}'no': no, 'd': d{'}'} ORDER BY no) AS run,
          CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY no)) ELSE any_value(d) END AS d
        FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {nodes}) GROUP BY g, no // 8"""

    def climb(rows: str, runs: str) -> str:
        side = "array_to_string(list_transform(list_filter(run[2:], lambda x: x.no {} w.no), lambda x: x.d), '')"
        left, right = side.format("<"), side.format(">")
        return f"""SELECT w.* EXCLUDE (no, f, proof), w.no // 8 AS no, CASE WHEN hashed THEN sha256({left} || f || {right}) ELSE f END AS f,
          CASE WHEN hashed THEN proof || {left} || {right} ELSE proof END AS proof
        FROM {rows} w JOIN {runs} r ON r.g = w.g AND r.no = w.no // 8"""

    crc = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce(
      [xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)"""
    capitals = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""l AS (
      SELECT doc_id, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS no, {leaf("text")} AS d,
        CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(capitals)} ELSE {leaf("text")} END AS f FROM documents
    ), n0 AS (SELECT g, no, d FROM l), w0 AS (SELECT doc_id, g, no, d AS leaf, f, '' AS proof FROM l)"""]
    for k in range(levels):
        steps.append(f"n{k + 1} AS ({level(f'n{k}', k)}), w{k + 1} AS ({climb(f'w{k}', f'n{k + 1}')})")
    steps.append(f"s AS (SELECT g AS name, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS no FROM n{levels})")
    steps.append(f"m0 AS (SELECT '' AS g, no, subroot AS d FROM s), x0 AS (SELECT doc_id, leaf, subroot, '' AS g, s.no, f, proof FROM w{levels} w JOIN s ON s.name = w.g)")
    for k in range(3):
        steps.append(f"m{k + 1} AS ({level(f'm{k}', k)}), x{k + 1} AS ({climb(f'x{k}', f'm{k + 1}')})")
    return f"""WITH {", ".join(steps)}
    SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM x3, (SELECT d FROM m3)"""


@query(_manifest_sql())
def op13_rank_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, a third of them altered."""
    from .manifest import manifest

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(
        _table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": F.when(hit, lowered).otherwise(F.col("text"))}
    ).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query()
def op12_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from .fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


@query(
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
    """
)
def op11_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector among all vectors."""
    from .negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(
        _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, F.transform("embedding", lambda x: x.cast("double") * 256)
    )
