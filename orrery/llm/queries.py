"""The queries of the thirteen operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import chat, exact_dedup, language_model, line_dedup, packing, quality_classifier, quality_rules, repair, resampling, simhash, toxicity, warc
from orrery.llm.bpe import round_trip_digests
from orrery.session import ship

TOKENIZERS = None


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file lies: in TOKENIZERS if that is set, else where the package has it."""
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.LineIndex(spark).insert(docs).clean(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language_model.held_out(F.col("doc_id")))
    return language_model.score_texts(docs)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT -7L AS conv_id, 0 AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -7L, 1, 'assistant', '{said}'")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.read_back(chat.format_chats(turns)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damage(turns), turns)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    found = (op1_warc, op2_simhash, op3_bpe, op4_packing, op5_line_dedup, op6_quality_rules, op7_lm_scoring, op8_exact_dedup, op9_chat, op10_quality_classifier, op11_resampling, op12_repair, op13_toxicity)
    return {f.__name__: f for f in found}


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|</?SYS>>|\|(?:text|next)\|>|/?INST\])', '\1\\\2\3', 'g')"

# CRC-32 of a string's UTF-8 bytes, one after the other, by a table made from its polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"


def crc_sql(c: str) -> str:
    octets = f"list_transform(range(octet_length(encode({c}))), lambda i: ('0x' || substr(hex(encode({c})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, crc_table[xor(c & 255, x) + 1])), 4294967295)"


def floor_div(a: str, b: str) -> str:
    return f"(({a}) - (({a}) % ({b}) + ({b})) % ({b})) // ({b})"


ORACLE_SQL = {
    "op11_resampling": f"""
        WITH c AS ({CRC_TABLE}),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        f AS (SELECT r, unnest(w) AS g FROM d UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
        h AS (SELECT unnest(w) AS g FROM e UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM e),
        k AS (SELECT g, {crc_sql('g')} % 10000 AS b FROM (SELECT g FROM f UNION SELECT g FROM h), c),
        s AS (SELECT b, count(*) AS s FROM f JOIN k USING (g) GROUP BY b),
        t AS (SELECT b, count(*) AS t FROM h JOIN k USING (g) GROUP BY b),
        z AS (SELECT (SELECT count(*) FROM f) AS all_s, (SELECT count(*) FROM h) AS all_t),
        gains AS (SELECT b, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b), z),
        sums AS (SELECT r, sum(gain)::BIGINT AS total FROM f JOIN k USING (g) JOIN gains USING (b) GROUP BY r),
        o AS (SELECT d.r, doc_id, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE 2 * len(w) - 1 END AS n_features, total FROM d LEFT JOIN sums USING (r)),
        v AS (SELECT *, CASE WHEN n_features = 0 THEN 0 ELSE {floor_div('total', 'n_features')} END AS weight, ('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM o),
        x AS (SELECT *, (weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM v),
        y AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= 20)
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM x LEFT JOIN y USING (r)""",
    "op12_repair": f"""
        WITH RECURSIVE c AS ({CRC_TABLE}),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        m AS (SELECT k.*, {crc_sql('key')} % 20 AS kind FROM k, c),
        b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE kind <> 0),
        n AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                     rtrim(text, {WHITE}) AS ended FROM b),
        f AS (SELECT *, CASE WHEN ended = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2 WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                     coalesce(left(lag(role) OVER w, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM n WINDOW w AS (PARTITION BY conv ORDER BY pos)),
        report AS (SELECT conv, any_value(conv_id) AS conv_id, max(pos) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                          count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv),
        -- States 0 to 3: nothing yet, after s, after u, after a. role: what may follow, and how a row can get there.
        step AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(state, initial, next)),
        more AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'user:'), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'),
                         (1, 2, 5, 'I', 'user:'), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'), (2, 3, 5, 'I', 'assistant:'), (3, 2, 5, 'I', 'user:')) AS v(state, next, cost, audit, said)),
        edit AS (SELECT conv, pos, s.state, s.state AS next, 2 AS cost, 'D' AS audit, '' AS said FROM f, (SELECT DISTINCT state FROM step) s
                 UNION ALL SELECT conv, pos, state, next, CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'K', role || ':' || text FROM f JOIN step ON left(role, 1) = initial WHERE fault IN (0, 3)
                 UNION ALL SELECT conv, pos, state, next, CASE WHEN fault = 3 THEN 6 ELSE 1 END, 'R', CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text FROM f, step WHERE initial <> 's' AND fault IN (0, 3)),
        p AS (SELECT conv, 0 AS pos, next AS state, cost::BIGINT AS cost, audit, said FROM report, more WHERE state = 0
              UNION ALL
              SELECT conv, pos, state, best.cost, best.audit, best.said FROM (
                  SELECT e.conv, e.pos, i.next AS state,
                         min({{'cost': p.cost + e.cost + i.cost, 'audit': p.audit || e.audit || i.audit,
                               'said': p.said || CASE WHEN p.said <> '' AND e.said <> '' THEN chr(10) ELSE '' END || e.said || CASE WHEN i.said <> '' AND p.said || e.said <> '' THEN chr(10) ELSE '' END || i.said}}) AS best
                  FROM p JOIN edit e ON e.conv = p.conv AND e.pos = p.pos + 1 AND e.state = p.state JOIN more i ON i.state = e.next GROUP BY e.conv, e.pos, i.next)),
        best AS (SELECT p.conv, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM p JOIN report r ON r.conv = p.conv AND r.rows = p.pos WHERE p.state IN (0, 3) GROUP BY p.conv),
        done AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(best.said) AS repaired_sha256 FROM report JOIN best USING (conv))
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, sha256(coalesce(html, '')) AS content FROM pages),
        q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY content) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM q""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r, doc_id""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS goes_on FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({ESCAPED.format("text")}) + CASE WHEN goes_on THEN 8 ELSE 3 + length({ESCAPED.format("role")}) + 8 + 4 END)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
