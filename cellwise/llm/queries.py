"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import chat_format, collocations, decontamination, language_id, media, ngram_join, sentencepiece_bpe, sharding, simhash, substring_dedup, suffix_dedup, vector_codes, warc
from cellwise.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.summarise(chat_format.prefix_examples(rows.unionByName(chat_format.awkward_conversation(rows))))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}



def _lloyd_sql(rounds: int = 4, parts: int = 4) -> str:
    """Plain Lloyd rounds over all vectors and entries, one pair of tables a round."""
    steps = [
        """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT vec_id, k, v[k * len(v) // {parts} + 1 : (k + 1) * len(v) // {parts}] AS v FROM e, range({parts}) t(k))",
        "c0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS i, v FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 256))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT vec_id, k, v, min({{'d': d, 'i': i}}) AS b FROM (SELECT p.vec_id, p.k, p.v, c.i, "
            f"list_inner_product(p.v, p.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v) AS d FROM p JOIN c{r} c USING (k)) GROUP BY vec_id, k, v)"
        )
        if r < rounds:
            steps.append(f"s{r} AS (SELECT k, i, j, floor(sum(x) / count(*)) AS x FROM (SELECT k, b.i AS i, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{r}) GROUP BY k, i, j)")
            steps.append(f"c{r + 1} AS (SELECT c.k, c.i, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, i, list(x ORDER BY j) AS v FROM s{r} GROUP BY k, i) n ON n.k = c.k AND n.i = c.i)")
    return f"""WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY k, i, j)) AS h FROM (SELECT k, i, unnest(v) AS x, unnest(range(len(v))) AS j FROM c{rounds})),
o AS (SELECT vec_id, string_agg(lower(printf('%02x', b.i)), '' ORDER BY k) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
q AS (SELECT o.*, e.label FROM o JOIN e USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM q"""


ORACLES = {
    "op11_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS own FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(own[k + 1 : k + 3], ' ') AS g FROM (SELECT doc_id, own, unnest(range(greatest(len(own) - 2, 1))) AS k FROM w WHERE len(own) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
""",
    "op12_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS own FROM t),
g AS (SELECT lang, m, array_to_string(own[k + 1 : k + m], ' ') AS phrase FROM (SELECT lang, own, m, unnest(range(len(own) - m + 1)) AS k FROM w, range(1, 6) r(m) WHERE len(own) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(len(own)) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 100),
d AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c x ON x.lang = s.lang AND x.m > s.m AND 100 * x.f >= 100 * s.f AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ')),
k AS (SELECT lang, phrase, f AS a, m, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS own FROM c ANTI JOIN d USING (lang, phrase)),
x AS (SELECT k.lang, k.phrase, a, k.k, l.f AS l, r.f AS r, n.n, (CAST(1000 AS HUGEINT) * a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(own[1 : k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(own[k + 1 :], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b)
SELECT * FROM o WHERE rank <= 2000
""",
    "op13_vector_codes": _lloyd_sql(),
    "op2_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *,
    15 + length(role) + length(text)
      + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars,
    row_number() OVER w AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), e AS (
  SELECT *, role = 'assistant' AS trained, role = 'assistant' OR k = n AS made,
    sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto
  FROM r
)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(length(coalesce(string_agg(CASE WHEN trained THEN text END, '' ORDER BY k), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN trained THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(CASE WHEN made THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN made THEN 1 ELSE 0 END) AS BIGINT) AS n_examples
FROM e GROUP BY conv_id
""",
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM documents),
p AS (SELECT doc_id, unnest(own) AS word, unnest(range(len(own))) AS k FROM w),
s AS (SELECT doc_id, k, sha256(array_to_string(own[k + 1 : k + 50], ' ')) AS h FROM (SELECT doc_id, own, unnest(range(len(own) - 49)) AS k FROM w WHERE len(own) >= 50)),
g AS (SELECT DISTINCT s.doc_id, s.k FROM s JOIN (SELECT h, min(doc_id) AS least FROM s GROUP BY h HAVING count(*) > 1) f USING (h) WHERE s.doc_id > f.least),
m AS (SELECT p.doc_id, p.k, p.word, max(g.k) OVER (PARTITION BY p.doc_id ORDER BY p.k) >= p.k - 49 AS gone FROM p LEFT JOIN g USING (doc_id, k)),
c AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone IS NOT TRUE) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d),
u AS (SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS bare FROM p)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN least < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < p.page_id THEN least END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':[0-9]*$', ''), '.')), ',')
    || ')' || regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS url_key
FROM p JOIN u USING (page_id) LEFT JOIN f ON f.d = p.d
""",
    "op8_decontamination": r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM documents),
i AS (SELECT DISTINCT item_id, n, array_to_string(own[k + 1 : k + n], ' ') AS w FROM (SELECT item_id, own, least(len(own), 10) AS n, unnest(range(greatest(len(own) - 9, 1))) AS k FROM b WHERE len(own) > 0)),
s AS (SELECT doc_id, n, k, array_to_string(own[k + 1 : k + n], ' ') AS w FROM (SELECT doc_id, own, n, unnest(range(len(own) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(own) >= n)),
h AS (SELECT s.doc_id, s.k, s.n, i.item_id FROM s JOIN i ON i.n = s.n AND i.w = s.w),
x AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM h GROUP BY doc_id),
r AS (SELECT doc_id, item_id, k, n, k - row_number() OVER (PARTITION BY doc_id, item_id, j - k ORDER BY k) AS run, j - k AS shift FROM (SELECT h.doc_id, h.item_id, h.k, h.n, b.j FROM h JOIN (SELECT item_id, least(len(own), 10) AS n, j, array_to_string(own[j + 1 : j + least(len(own), 10)], ' ') AS w FROM (SELECT item_id, own, unnest(range(greatest(len(own) - 9, 1))) AS j FROM b WHERE len(own) > 0)) b ON b.item_id = h.item_id JOIN s ON s.doc_id = h.doc_id AND s.k = h.k AND s.n = h.n AND s.w = b.w)),
l AS (SELECT doc_id, max(m) AS longest FROM (SELECT doc_id, count(*) - 1 + max(n) AS m FROM r GROUP BY doc_id, item_id, shift, run) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.own) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN l USING (doc_id)
""",
}
