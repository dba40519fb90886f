"""Queries over the store, search, conversations, timelines and pages, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import markdown as md
from ..functions import text as tx
from ..functions import urls
from ..operators import chunks as ch
from ..operators import conversation as conv
from ..operators import search as se
from ..operators import store as st
from ..operators import timeline as tl
from ..session import exists, work_path
from ..sources import html
from .text_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


#: The query of the search plans: words that every scale of the tables holds.
QUERY = "thing nation ention"
#: The three fields of a chunk made of a whole document.
FIELDS = "doc_id, CAST(0 AS INTEGER) AS idx, source AS title, 'https://' || source || '.example/' || lang AS url, text AS content"


def whole_chunks(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit(0).alias("idx"), F.col("source").alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang").alias("url"), F.col("text").alias("content"))


def kept_index(spark, sf_dir, name: str, chunks_of, key: list[str]) -> tuple[DataFrame, se.Index]:
    """The chunks that ``chunks_of`` makes of the documents, and their index. Both are written once for this state of the
    table's files and read by every later search, also of other sessions that share the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/documents.parquet")
    state = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()  # contents aren't read
    path = work_path(spark, f"index-{name}", "-".join(f"{(x or 0) & (2**64 - 1):x}" for x in state))
    if exists(spark, f"{path}/fields/_SUCCESS"):
        return spark.read.parquet(f"{path}/chunks"), se.open_index(spark, path)
    chunks_of(spark, sf_dir).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    return chunks, se.build_index(chunks, key, path)


def lexical(spark, sf_dir, tolerance: int = 0) -> DataFrame:
    """Scores of documents as whole chunks, by the kept index."""
    return se.search_index(kept_index(spark, sf_dir, "whole", whole_chunks, ["doc_id"])[1], QUERY, tolerance)


def page_store(spark, sf_dir) -> DataFrame:
    """A document store made of the pages: times stand in by page_id."""
    p = read(spark, sf_dir, "pages")
    t = F.col("page_id") * 1000
    return p.select(urls.document_id("url").alias("doc_id"), F.col("url").alias("source_url"), F.when(F.col("page_id") % 7 == 0, "pdf").otherwise("article").alias("kind"), t.alias("created_at"), (t + 5).alias("updated_at"), F.when(F.col("page_id") % 3 == 0, (t * 7) % 1000003).alias("last_viewed_at"))


STORE_SQL = "SELECT substr(sha256(url), 1, 24) AS doc_id, url AS source_url, CASE WHEN page_id % 7 = 0 THEN 'pdf' ELSE 'article' END AS kind, page_id * 1000 AS created_at, page_id * 1000 + 5 AS updated_at, CASE WHEN page_id % 3 = 0 THEN (page_id * 1000 * 7) % 1000003 END AS last_viewed_at FROM pages"


def unique_store(spark, sf_dir) -> DataFrame:
    return st.latest(page_store(spark, sf_dir), "doc_id", [F.col("created_at")])


UNIQUE_SQL = f"SELECT * FROM ({STORE_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC) = 1"


@query(f"SELECT doc_id, last_viewed_at, updated_at FROM ({UNIQUE_SQL}) ORDER BY coalesce(last_viewed_at, updated_at, 0) DESC, doc_id LIMIT 100")
def recent_documents(spark, sf_dir):
    return st.recent(unique_store(spark, sf_dir)).select("doc_id", "last_viewed_at", "updated_at")


@query(f"""
WITH s AS ({UNIQUE_SQL}),
i AS (SELECT substr(sha256(url), 1, 24) AS doc_id, url AS source_url, CASE WHEN page_id % 2 = 0 THEN 'youtube' END AS kind FROM pages WHERE page_id % 4 < 2 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
      UNION ALL SELECT substr(sha256('https://new.example/' || CAST(page_id AS VARCHAR)), 1, 24), 'https://new.example/' || CAST(page_id AS VARCHAR), 'article' FROM pages WHERE page_id % 5 = 0)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN i.doc_id IS NULL THEN s.source_url ELSE i.source_url END AS source_url, CASE WHEN i.doc_id IS NULL THEN s.kind ELSE i.kind END AS kind,
  coalesce(s.created_at, 999999999) AS created_at, CASE WHEN i.doc_id IS NULL THEN s.updated_at ELSE 999999999 END AS updated_at, CASE WHEN i.doc_id IS NULL THEN s.last_viewed_at ELSE 999999999 END AS last_viewed_at
FROM s FULL JOIN i ON s.doc_id = i.doc_id
""")
def document_upsert(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    again = st.latest(p.filter("page_id % 4 < 2").select(F.col("url").alias("source_url"), F.when(F.col("page_id") % 2 == 0, "youtube").alias("kind"), "page_id"), "source_url", [F.col("page_id")]).drop("page_id")
    new = p.filter("page_id % 5 = 0").select(F.concat(F.lit("https://new.example/"), F.col("page_id").cast("string")).alias("source_url"), F.lit("article").alias("kind"))
    out = st.upsert(unique_store(spark, sf_dir), again.unionByName(new), 999999999)
    return out.select("doc_id", "source_url", "kind", "created_at", "updated_at", "last_viewed_at")


@query(f"""
WITH s AS ({UNIQUE_SQL}), t AS (SELECT DISTINCT substr(sha256(url), 1, 24) AS doc_id FROM pages WHERE page_id % 10 = 3)
SELECT s.* EXCLUDE (last_viewed_at), CASE WHEN t.doc_id IS NOT NULL THEN 77 ELSE s.last_viewed_at END AS last_viewed_at FROM s LEFT JOIN t ON s.doc_id = t.doc_id
""")
def document_touch(spark, sf_dir):
    keys = read(spark, sf_dir, "pages").filter("page_id % 10 = 3").select(urls.document_id("url").alias("doc_id"))
    return st.touch(unique_store(spark, sf_dir), keys, 77)


@query(f"SELECT * FROM ({UNIQUE_SQL}) WHERE doc_id NOT IN (SELECT substr(sha256(url), 1, 24) FROM pages WHERE page_id % 10 = 3)")
def document_delete(spark, sf_dir):
    keys = read(spark, sf_dir, "pages").filter("page_id % 10 = 3").select(urls.document_id("url").alias("doc_id"))
    return st.remove(unique_store(spark, sf_dir), keys)


@query(f"""
WITH s AS ({UNIQUE_SQL}), e AS (SELECT substr(sha256(url), 1, 24) AS doc_id, 'unit-64' AS embedding_model FROM pages WHERE page_id % 6 = 1 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT s.doc_id, e.embedding_model, s.updated_at FROM s LEFT JOIN e ON s.doc_id = e.doc_id
""")
def document_embeddings_update(spark, sf_dir):
    """The model's name set on some documents; updated_at stays."""
    e = read(spark, sf_dir, "pages").filter("page_id % 6 = 1").select(urls.document_id("url").alias("doc_id"), F.lit("unit-64").alias("embedding_model")).distinct()
    return st.update(unique_store(spark, sf_dir), e).select("doc_id", "embedding_model", "updated_at")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def documents_to_embed(spark, sf_dir):
    done = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return st.without_embeddings(read(spark, sf_dir, "documents").select("doc_id"), done)


@query()
def chunk_texts(spark, sf_dir):
    """Chunks of every document; tested against the rule's cases."""
    return ch.chunk_rows(read(spark, sf_dir, "documents"), title_col="source")


def _bm25_sql(terms: str, tolerance: int, fields: tuple[tuple[str, float], ...] = (("title", 3.0), ("url", 2.0), ("content", 1.0))) -> str:
    # The built-in levenshtein counts bytes; within one edit of code points, some prefix and the rest behind the edit agree.
    a, b = "v.term", "q.term"
    edit = lambda i, j: f"len(list_filter(range(0, length({a}) + 1), lambda k: left({a}, k) = left({b}, k) AND substr({a}, k + {i}) = substr({b}, k + {j}))) > 0"
    near = f"CASE length({a}) - length({b}) WHEN 0 THEN {edit(2, 2)} WHEN 1 THEN {edit(2, 1)} WHEN -1 THEN {edit(1, 2)} ELSE false END"
    match = f"SELECT v.term FROM (SELECT DISTINCT term FROM t) v, q WHERE {near if tolerance else 'v.term = q.term'}"
    union = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w}::DOUBLE AS boost, regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+') AS ts FROM c" for f, w in fields)
    return f"""
c AS (SELECT {FIELDS} FROM documents),
f AS ({union}),
l AS (SELECT field, count(*) AS n, avg(len(ts)) AS mean FROM f GROUP BY field),
t AS (SELECT doc_id, field, boost, len(ts) AS dl, unnest(ts) AS term FROM f),
q AS (SELECT unnest({terms}) AS term),
tf AS (SELECT doc_id, field, boost, dl, term, count(*) AS tf FROM t WHERE term IN ({match}) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT doc_id, sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score
      FROM tf JOIN df USING (field, term) JOIN l USING (field) GROUP BY doc_id)"""


TERMS = "['thing', 'nation', 'ention']"


@query(f"WITH {_bm25_sql(TERMS, 0)} SELECT doc_id, round(score, 6) AS score FROM s")
def lexical_bm25(spark, sf_dir):
    return lexical(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(TERMS, 1)} SELECT doc_id, round(score, 6) AS score FROM s")
def lexical_tolerance1(spark, sf_dir):
    return lexical(spark, sf_dir, 1).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(TERMS, 1)} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 100)")
def lexical_top100(spark, sf_dir):
    return se.top_hits(lexical(spark, sf_dir, 1), ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


DOT = "list_sum(list_transform(list_zip(embedding, q.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def query_vector(spark, sf_dir) -> list[float]:
    row = read(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row[0]) if row is not None else [0.0]


@query(f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({DOT}, 6) AS score FROM embeddings, q WHERE {DOT} >= 0.18 ORDER BY round({DOT}, 9) DESC, vec_id LIMIT 100")
def vector_topk(spark, sf_dir):
    v = se.vector_scores(read(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), ["vec_id"], "embedding")
    return se.top_hits(v, ["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


HYBRID = f"""{_bm25_sql(TERMS, 0)},
q2 AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id AS doc_id, list_sum(list_transform(list_zip(embedding, q2.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS v FROM embeddings, q2),
h AS (SELECT coalesce(s.doc_id, e.doc_id) AS doc_id, 0.5::DOUBLE * coalesce(s.score / (SELECT max(score) FROM s), 0) + 0.5::DOUBLE * coalesce(e.v, 0) AS score, s.doc_id IS NULL AS semantic_only
      FROM s FULL JOIN (SELECT * FROM e WHERE v >= 0.18) e ON s.doc_id = e.doc_id)"""


def hybrid(spark, sf_dir) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return se.hybrid_scores(lexical(spark, sf_dir), se.vector_scores(vectors, query_vector(spark, sf_dir), ["doc_id"], "embedding"), ["doc_id"])


@query(f"WITH {HYBRID} SELECT doc_id, round(score, 6) AS score FROM h")
def hybrid_search(spark, sf_dir):
    """Documents' ids stand in for their vectors' ids."""
    return hybrid(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {HYBRID} SELECT doc_id, round(score, 6) AS score FROM h WHERE semantic_only")
def semantic_only(spark, sf_dir):
    return hybrid(spark, sf_dir).join(lexical(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("doc_id", F.round("score", 6).alias("score"))


def library_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of all documents with their title."""
    titled = ch.chunk_rows(read(spark, sf_dir, "documents"), title_col="source", with_title=True)
    return titled.withColumnRenamed("_title", "title")


@query()
def search_library(spark, sf_dir):
    """BM25 with tolerance over the kept index of chunks, top hundred chunks, best chunk per document, reason and snippet."""
    parts, index = kept_index(spark, sf_dir, "library", library_chunks, ["doc_id", "idx"])
    hits = se.top_hits(se.search_index(index, QUERY, 1), ["doc_id", "idx"])
    best = F.broadcast(se.best_per_document(hits))  # a hundred rows at most
    shown = parts.join(best, ["doc_id", "idx"])
    terms = tx.query_terms(F.lit(QUERY))
    reason = se.match_reason(F.lit(False), F.col("title"), F.lit(""), F.col("content"), terms)
    return shown.select("doc_id", "idx", F.round("score", 6).alias("score"), reason.alias("reason"), tx.snippet(F.col("content"), F.col("title"), terms).alias("snippet"))


@query(r"""
WITH t AS (SELECT doc_id, source, text, lower(text) AS low FROM documents)
SELECT doc_id, CASE WHEN contains(lower(source), 'thing') OR contains(lower(source), 'nation') THEN 'Title match'
  WHEN contains(low, 'thing') OR contains(low, 'nation') THEN 'Passage match' ELSE 'Related passage' END AS reason FROM t
""")
def match_reasons(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", se.match_reason(F.lit(False), F.col("source"), F.lit(None).cast("string"), F.col("text"), tx.query_terms(F.lit("thing nation"))).alias("reason"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
p AS (SELECT doc_id, x, strpos(lower(x), 'nation') - 1 AS hit, length(x) AS n FROM t),
a AS (SELECT *, CASE WHEN hit >= 0 THEN greatest(0, hit - 110) ELSE 0 END AS s0 FROM p),
b AS (SELECT *, CASE WHEN s0 > 0 AND strpos(substr(x, s0 + 1), ' ') > 0 THEN s0 + strpos(substr(x, s0 + 1), ' ') ELSE s0 END AS s FROM a),
c AS (SELECT *, least(n, s + 360) AS e0 FROM b),
d AS (SELECT *, substr(x, 1, e0 + 1) AS head FROM c),
e AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') ELSE -1 END AS sp FROM d),
f AS (SELECT *, CASE WHEN e0 < n AND sp > s THEN sp ELSE e0 END AS e FROM e)
SELECT doc_id, (CASE WHEN s > 0 THEN '…' ELSE '' END) || trim(substr(x, s + 1, e - s)) || (CASE WHEN e < n THEN '…' ELSE '' END) AS snippet FROM f
""")
def snippets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), F.lit(""), F.array(F.lit("nation"))).alias("snippet"))


@query(r"SELECT item_id, regexp_replace(text, '(?i)(nation|thing)', '<mark>\1</mark>', 'g') AS marked FROM benchmark")
def highlighted(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", tx.highlight(F.col("text"), F.array(F.lit("nation"), F.lit("thing"))).alias("marked"))


@query("SELECT user_id, event_id, round(value, 6) AS best FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) = 1")
def best_hit_per_document(spark, sf_dir):
    """Events stand in for hits: users for documents, values for scores."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), F.col("value").alias("score"))
    return se.best_per_document(e).select(F.col("doc_id").alias("user_id"), F.col("idx").alias("event_id"), F.round("score", 6).alias("best"))


GROUPS = """
WITH s AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS change FROM conversations WHERE role IN ('user', 'assistant')),
g AS (SELECT conv_id, turn, role, CAST(sum(change) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS chat_group,
        CASE WHEN change = 1 THEN CASE role WHEN 'user' THEN 'You' ELSE 'Assistant' END END AS chat_speaker FROM s
      UNION ALL SELECT conv_id, turn, role, NULL, NULL FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
"""


@query(GROUPS + "SELECT * FROM g")
def chat_groups(spark, sf_dir):
    return conv.turn_groups(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query(GROUPS + "SELECT conv_id, count(DISTINCT chat_group) AS headings FROM g GROUP BY conv_id")
def chat_headings(spark, sf_dir):
    g = conv.turn_groups(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))
    return g.groupBy("conv_id").agg(F.count("chat_speaker").alias("headings"))


@query(r"""
WITH r AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'You said' WHEN 'assistant' THEN 'ChatGPT' END AS label FROM conversations),
p AS (SELECT conv_id, turn * 2 AS pos, label AS text FROM r WHERE label IS NOT NULL UNION ALL SELECT conv_id, turn * 2 + 1, text FROM r),
l AS (SELECT *, CASE WHEN regexp_matches(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '(?i)^(you|user|assistant|chatgpt|claude|gemini|grok)(\s+said)?$') THEN 1 ELSE 0 END AS is_label FROM p),
g AS (SELECT *, sum(is_label) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS grp,
        last_value(CASE WHEN is_label = 1 THEN CASE WHEN lower(trim(text)) LIKE 'you%' THEN 'user' ELSE 'assistant' END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS who FROM l)
SELECT conv_id, pos, CASE WHEN grp >= 0 THEN who END AS chat_role, CAST(CASE WHEN grp >= 0 THEN grp END AS INTEGER) AS chat_group,
  CASE WHEN grp >= 0 AND row_number() OVER (PARTITION BY conv_id, grp ORDER BY pos) = 1 THEN CASE who WHEN 'user' THEN 'You' ELSE 'ChatGPT' END END AS chat_speaker
FROM g WHERE is_label = 0
""")
def decorated_passages(spark, sf_dir):
    """Turns as a saved chat shows them: a label row before each user and assistant turn."""
    c = read(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "user", "You said").when(F.col("role") == "assistant", "chatgpt")
    rows = c.select("conv_id", F.explode(F.array(F.struct((F.col("turn") * 2).alias("pos"), label.alias("text")), F.struct((F.col("turn") * 2 + 1).alias("pos"), F.col("text").alias("text")))).alias("p")).select("conv_id", "p.pos", "p.text", F.lit("paragraph").alias("type"))
    rows = rows.filter("not (pos % 2 = 0 and text is null)")
    return conv.decorate(rows, F.lit("ChatGPT"), "conv_id").select("conv_id", "pos", "chat_role", "chat_group", "chat_speaker")


@query(GROUPS + r""",
x AS (SELECT g.conv_id, g.turn, (CASE WHEN chat_speaker IS NOT NULL THEN '### ' || chat_speaker || chr(10) || chr(10) ELSE '' END) || regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g') AS part
      FROM g JOIN conversations c ON g.conv_id = c.conv_id AND g.turn = c.turn)
SELECT conv_id, md5(regexp_replace(regexp_replace('# Conversation ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || array_to_string(list(part ORDER BY turn), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS markdown_md5
FROM x GROUP BY conv_id
""")
def markdown_conversations(spark, sf_dir):
    c = conv.turn_groups(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    head = F.when(F.col("chat_speaker").isNotNull(), F.concat(F.lit("### "), "chat_speaker", F.lit("\n\n"))).otherwise("")
    parts = c.select("conv_id", "turn", F.concat(head, md.escape_inline("text")).alias("part"))
    body = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("b"))
    none = F.lit(None).cast("string")
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    text = md.article(title, none, none, none, none, none, F.transform("b", lambda x: x["part"]))
    return body.select("conv_id", F.md5(text).alias("markdown_md5"))


#: Milliseconds that one window of the as-of joins sees.
HOUR = 3_600_000


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000.0::DOUBLE AS ms, event_type FROM events),
t AS (SELECT user_id, ms, max(event_id) AS event_id FROM e WHERE event_id % 3 = 0 GROUP BY 1, 2),
c AS (SELECT event_id, user_id, ms + 120 AS ms FROM e WHERE event_id % 3 <> 0)
SELECT c.event_id, t.event_id AS matched FROM c ASOF LEFT JOIN t ON c.user_id = t.user_id AND c.ms >= t.ms
""")
def asof_timeline(spark, sf_dir):
    """Each third event is a sentence's start on its user's timeline; the others are clock readings (tolerance 120 ms)."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"))
    line = e.filter("event_id % 3 = 0").groupBy("user_id", "ms").agg(F.max("event_id").alias("event_id"))
    return tl.as_of(e.filter("event_id % 3 <> 0"), line, "user_id", "ms", F.col("event_id"), 120, span=HOUR).select("event_id", "matched")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000.0::DOUBLE AS ms FROM events),
t AS (SELECT user_id, ms, max(event_id) AS event_id FROM e WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT c.event_id, t.event_id AS matched FROM (SELECT * FROM e WHERE event_id % 3 <> 0) c ASOF LEFT JOIN t ON c.user_id = t.user_id AND c.ms <= t.ms
""")
def asof_next(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"))
    line = e.filter("event_id % 3 = 0").groupBy("user_id", "ms").agg(F.max("event_id").alias("event_id"))
    return tl.as_of(e.filter("event_id % 3 <> 0"), line, "user_id", "ms", F.col("event_id"), forward=True, span=HOUR).select("event_id", "matched")


@query("""
WITH s AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS a, CAST(epoch(ts) AS BIGINT) + CAST(floor(abs(value)) AS BIGINT) * 60 + 1 AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT event_id, user_id FROM m WHERE before IS NULL OR a >= before
""")
def outer_spans(spark, sf_dir):
    """Events as spans of their user from the nearest second on (half a second: to the even one); of equal spans the smallest id stays."""
    e = read(spark, sf_dir, "events")
    start = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint")
    s = e.select("event_id", "user_id", start.alias("a"), (start + F.floor(F.abs("value")) * 60 + 1).alias("b"))
    return tl.keep_outer(s, "user_id", "a", "b", "event_id").select("event_id", "user_id")


@query("""
WITH h AS (SELECT doc_id // 40 AS d, doc_id // 2 % 2 AS p, n_chars % 97 AS s, n_chars % 97 + 1 + doc_id % 7 AS e FROM documents WHERE doc_id % 2 = 0),
q AS (SELECT DISTINCT doc_id // 40 AS d, doc_id // 2 % 2 AS p, n_chars % 89 AS s, n_chars % 89 + 1 + doc_id % 5 AS e FROM documents WHERE doc_id % 2 = 1)
SELECT q.d AS doc_id, q.p AS passage_index, q.s AS "start", q.e AS "end", CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.d = q.d AND h.p = q.p AND q.s < h.e AND q.e > h.s) THEN 'delete' ELSE 'add' END AS action FROM q
""")
def highlight_overlaps(spark, sf_dir):
    """Documents stand in for highlights, the odd ones for new ones; forty make a document of two passages."""
    d = read(spark, sf_dir, "documents")
    span = lambda k, m, n: d.filter(f"doc_id % 2 = {k}").selectExpr("doc_id DIV 40 AS doc_id", "doc_id DIV 2 % 2 AS passage_index", f"n_chars % {m} AS start", f"n_chars % {m} + 1 + doc_id % {n} AS end")
    return st.free_highlights(span(0, 97, 7), span(1, 89, 5).distinct())


@query(r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, source, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line FROM l)
SELECT source, line, count(DISTINCT doc_id) AS documents FROM k WHERE length(line) BETWEEN 4 AND 240 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2
""")
def marginal_repeats(spark, sf_dir):
    """Lines repeated across a source's documents, as marginals repeat across a document's pages."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    k = d.select("doc_id", "source", F.lower(tx.collapse("line")).alias("line")).filter(F.length("line").between(4, 240))
    # one row per document and line first, so that the count needs no set per line
    return k.distinct().groupBy("source", "line").agg(F.count("*").alias("documents")).filter("documents >= 2")


@query()
def html_passages(spark, sf_dir):
    return html.html_passages(read(spark, sf_dir, "pages")).select("page_id", "pos", "type", "text", F.size(F.coalesce("links", F.array())).alias("n_links"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) AS t FROM pages)
SELECT page_id, count(*) AS headings FROM h GROUP BY page_id
""")
def html_headings(spark, sf_dir):
    p = html.html_passages(read(spark, sf_dir, "pages")).filter("type = 'heading'")
    return p.groupBy("page_id").agg(F.count("*").alias("headings"))


@query()
def page_texts(spark, sf_dir):
    p = html.html_passages(read(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id")
    t = ch.document_text(p)
    return t.select(F.col("doc_id").alias("page_id"), F.md5("text").alias("text_md5"), tx.word_count("text").alias("words"))


@query("""
WITH b AS (SELECT p_partkey AS k, p_size * 1.0::DOUBLE AS x, (p_partkey % 50) * 1.0::DOUBLE AS y, (p_partkey % 13 + 1) * 3.0::DOUBLE AS w FROM part)
SELECT k, round(greatest(0, least(x + w, 40) - greatest(x, 10)) * greatest(0, least(y + 5, 30) - greatest(y, 5)) / greatest(1, w * 5), 9) AS contained,
  CASE WHEN y + 5 <= 6 THEN 'top' WHEN y >= 44 THEN 'bottom' ELSE '' END AS marginal FROM b
""")
def box_geometry(spark, sf_dir):
    b = read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CAST(p_size AS DOUBLE) AS x", "CAST(p_partkey % 50 AS DOUBLE) AS y", "(p_partkey % 13 + 1) * 3.0D AS w")
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + 5).alias("y2"))
    page = F.struct(F.lit(10.0).alias("x1"), F.lit(5.0).alias("y1"), F.lit(40.0).alias("x2"), F.lit(30.0).alias("y2"))
    return b.select("k", F.round(geo.containment(box, page), 9).alias("contained"), geo.marginal(F.col("y"), F.col("y") + 5, F.lit(50.0)).alias("marginal"))


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1")
def main_language(spark, sf_dir):
    """Each source's most frequent language."""
    d = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    w = Window.partitionBy("source").orderBy(F.col("documents").desc(), "lang")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
