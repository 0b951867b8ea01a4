"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, lm, merkle, minhash, pieces, quality, resample, secrets, sharding, simhash, substrings, warc

#: The public vocabulary that the queries use; a parameter of `pieces.load`.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Learned from the labelled rows whose remainder of 3 is not 1."""
    labels = _table(spark, sf_dir, "labels").where(remainder(3) != 1)
    return quality.fit(_table(spark, sf_dir, "documents"), labels, label_col="quality")


def op1_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_lm(spark, sf_dir):
    return lm.score_texts(_table(spark, sf_dir, "documents"), remainder(7) == 2)


def op3_substrings(spark, sf_dir):
    return substrings.digest(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op4_simhash(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op5_quality(spark, sf_dir):
    found = quality.classify(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op6_exact(spark, sf_dir):
    return exact.digest(exact.dedup_exact(_table(spark, sf_dir, "documents")))


def op7_warc(spark, sf_dir):
    return warc.digest(warc.round_trip(_table(spark, sf_dir, "pages")))


def op8_pieces(spark, sf_dir):
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents"), pieces.load(VOCABULARY)))


def op9_sharding(spark, sf_dir):
    return sharding.digest(sharding.shard(_table(spark, sf_dir, "documents")))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_merkle(spark, sf_dir):
    told = F.when(remainder(7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.digest(merkle.verified(merkle.manifest(_table(spark, sf_dir, "documents"), claimed={"n_chars": told})))


def op12_resample(spark, sf_dir):
    return resample.digest(resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op13_minhash(spark, sf_dir):
    return minhash.digest(minhash.near_duplicates(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_lm, op3_substrings, op4_simhash, op5_quality, op6_exact, op7_warc, op8_pieces, op9_sharding, op10_decontaminate, op11_merkle, op12_resample, op13_minhash)
    return {f.__name__: f for f in own}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ITEM_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWERED)

#: CRC-32 in SQL: what a byte makes of the state, and the fold over a string's bytes with that table (t.t).
_CRC_TABLE = "(WITH RECURSIVE x AS (SELECT i, i AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM x WHERE k < 8) SELECT list(c ORDER BY i) AS t FROM x WHERE k = 8)"


def _crc(s: str) -> str:
    state = f"list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({s}) + 1), lambda i: CAST('0x' || hex(encode({s}))[2 * i - 1:2 * i] AS BIGINT)))"
    return f"xor(list_reduce({state}, lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _leaf(chars: str) -> str:
    values = ("doc_id", "source", "lang", chars, "text")
    return " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values)


ORACLE = {
    "op3_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
             k AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY sha256(array_to_string(w[s:s + 49], ' '))) AS first FROM p),
             g AS (SELECT DISTINCT doc_id, s + unnest(range(0, 50)) AS i FROM k WHERE first < doc_id),
             t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
             r AS (SELECT t.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept
                   FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op10_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
             b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
             v AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
             a AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n),
             h AS (SELECT doc_id, s, a.n, item_id FROM a JOIN v ON v.n = a.n AND v.x = array_to_string(w[s:s + a.n - 1], ' ')),
             c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, s + unnest(range(0, n)) AS i FROM h) GROUP BY 1),
             e AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
    "op11_merkle": rf"""
        WITH RECURSIVE t AS {_CRC_TABLE},
             d AS (SELECT doc_id, lang, sha256({_leaf("n_chars")}) AS leaf,
                          CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({_leaf("n_chars + 1")}) ELSE sha256({_leaf("n_chars")}) END AS told FROM documents, t),
             p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
             g AS (SELECT lang, 0 AS level, pos, n, leaf AS digest FROM p
                   UNION ALL SELECT lang, any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM g WHERE n > 1 GROUP BY lang, pos // 2),
             s AS (SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM g WHERE n = 1),
             u AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s
                   UNION ALL SELECT any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 2),
             o AS (SELECT max(level) AS height, max(digest) FILTER (n = 1) AS root FROM u),
             l AS (SELECT p.doc_id, g.level AS step, (p.pos >> g.level) % 2 AS side, g.digest AS sibling FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang AND g.pos = xor(p.pos >> g.level, 1) AND g.n > 1
                   UNION ALL SELECT p.doc_id, s.height + u.level, (s.pos >> u.level) % 2, u.digest FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN u ON u.pos = xor(s.pos >> u.level, 1) AND u.n > 1),
             f AS (SELECT p.doc_id, 0 AS step, told AS digest, height + (SELECT height FROM o) AS steps FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang
                   UNION ALL SELECT f.doc_id, f.step + 1, sha256(CASE side WHEN 0 THEN digest || sibling WHEN 1 THEN sibling || digest ELSE digest END), steps
                   FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.step = f.step WHERE f.step < steps),
             b AS (SELECT doc_id, sha256(string_agg(sibling, '' ORDER BY step)) AS proof FROM l GROUP BY 1)
        SELECT p.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
        FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN f ON f.doc_id = p.doc_id AND f.step = f.steps CROSS JOIN o LEFT JOIN b ON b.doc_id = p.doc_id""",
    "op12_resample": rf"""
        WITH t AS {_CRC_TABLE},
             w AS (SELECT 0 AS side, doc_id, {_ITEM_WORDS} AS w FROM documents UNION ALL SELECT 1, NULL, {_ITEM_WORDS} FROM benchmark),
             e AS (SELECT side, doc_id, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) AS r(n) WHERE len(w) >= n)),
             f AS (SELECT side, doc_id, gram, count(*) AS c FROM e GROUP BY 1, 2, 3),
             k AS (SELECT gram, {_crc("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM f), t),
             z AS (SELECT bucket, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t FROM f JOIN k USING (gram) GROUP BY 1),
             a AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM z),
             g AS (SELECT bucket, CAST(floor(1000 * ln((z.t + 1.0) * (a.s + 10000) / ((z.s + 1.0) * (a.t + 10000)))) AS BIGINT) AS gain FROM z, a),
             v AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM f JOIN k USING (gram) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
             h AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
                   FROM w LEFT JOIN v USING (doc_id) WHERE side = 0),
             r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM h WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM h LEFT JOIN r USING (doc_id)""",
    "op13_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS e FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
             l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b USING (e) GROUP BY 1, 2),
             k AS (SELECT a, b FROM l JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
             r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b),
             m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(b, d.doc_id) AS component_id, coalesce(b, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON a = d.doc_id""",
    "op6_exact": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
                          min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM q""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
