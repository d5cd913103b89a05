"""Queries: documents, news, pages, classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify, text
from tidemark.functions.times import iso
from tidemark.operators import dedup, news, pages, quality, scoring, sentiment
from tidemark.plans.base import query
from tidemark.plans.common import stored, table
from tidemark.session import spread


def _pick(key: str, *values: str | None) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed: every third by its own URL, some twice, some without title or time."""
    d = table(spark, sf_dir, "documents")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d.select(
        _pick("doc_id", "Fed", "ecb", "BoE", "other").alias("source"),
        stamp.alias("timestamp_collected"),
        F.when(F.col("doc_id") % 2 == 0, stamp).otherwise("").alias("timestamp_published"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://x/"), F.floor(F.col("doc_id") / 6).cast("string"))).otherwise("").alias("url"),
        F.when(F.col("doc_id") % 10 == 9, "").otherwise(F.concat(F.lit(" Note  "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("doc_id") % 5 == 0, "speech").alias("document_type"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("A B")).alias("speaker"),
        F.col("lang").alias("author"),
        F.col("doc_id").alias("_doc_id"),
    )


ARTICLES = """
raw AS (
  SELECT doc_id, ['fed', 'ecb', 'boe', 'other'][doc_id % 4 + 1] AS source, strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc,
         CASE WHEN doc_id % 3 = 0 THEN 'https://x/' || CAST(doc_id // 6 AS VARCHAR) END AS url, ' Note  ' || CAST(doc_id AS VARCHAR) AS title,
         CASE WHEN doc_id % 5 = 0 THEN 'speech' ELSE 'article' END AS document_type, CASE WHEN doc_id % 7 = 0 THEN 'A B' ELSE lang END AS speaker
  FROM documents WHERE doc_id % 10 <> 9),
article AS (
  SELECT doc_id, timestamp_utc, substr(sha256(coalesce(url, source || '|' || title || '|' || timestamp_utc)), 1, 16) AS article_id,
         CASE source WHEN 'fed' THEN 'USD' WHEN 'ecb' THEN 'EUR' WHEN 'boe' THEN 'GBP' ELSE 'OTHER' END AS currency, 'Note ' || CAST(doc_id AS VARCHAR) AS headline, document_type, speaker, source, url
  FROM raw QUALIFY row_number() OVER (PARTITION BY coalesce(url, source || '|' || title || '|' || timestamp_utc) ORDER BY doc_id) = 1)
"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = news.articles(_bronze(spark, sf_dir))
    return news.deduplicated_articles(found, ["_doc_id"]).withColumn("timestamp_utc", iso(F.col("timestamp_utc")))


@query("article_silver", f"WITH {ARTICLES} SELECT * EXCLUDE (doc_id) FROM article")
def article_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).drop("_doc_id")


@query("rejected_articles", "SELECT doc_id FROM documents WHERE doc_id % 10 = 9")
def rejected_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.articles(_bronze(spark, sf_dir))[1].select(F.col("_doc_id").alias("doc_id"))


@query("sentiment_counts", "SELECT source, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return joined.groupBy("source", label.alias("label")).agg(F.count("*").alias("n"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.when(F.col("p_partkey") % 5 == 0, "n.d.").otherwise(F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 60), "yyyyMMddHHmmss")).alias("date"),
        F.concat(F.lit("https://n/"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("url"),
        _pick("p_partkey", "www.reuters.com", "wsj.com", "microsoft.com", "blog.net").alias("source_domain"),
        F.col("p_size").cast("string").alias("tone"),
        F.concat(_pick("p_partkey", "ECON_CURRENCY;EUR ", "ECON_CENTRAL_BANK; USD", "TAX;EUR", "ECON_CURRENCY"), F.lit(";"), F.col("p_brand")).alias("themes"),
        F.col("p_type").alias("locations"),
        F.lit(None).cast("string").alias("organizations"),
        "p_partkey",
    )


GRAPH = """
g AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'n.d.' ELSE strftime(TIMESTAMP '2024-01-01' + p_partkey * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS published, 'https://n/' || CAST(p_partkey // 2 AS VARCHAR) AS url,
             [1, 2, 1, 3][p_partkey % 4 + 1] AS tier, [2, 2, 2, 1][p_partkey % 4 + 1] + 1 AS n_themes, CAST(p_size AS VARCHAR) AS tone FROM part
      WHERE p_partkey % 4 < 2 QUALIFY row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) = 1)
"""


@query("gkg_documents", f"WITH {GRAPH} SELECT url, published AS timestamp_published, tone, tier AS credibility_tier, sha256(url) AS url_hash, n_themes, 0 AS n_organizations FROM g")
def gkg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news.graph_documents(_graph(spark, sf_dir).where(news.wanted_themes()), ["p_partkey"])
    return rows.select("url", "timestamp_published", "tone", "metadata.credibility_tier", "metadata.url_hash", F.size("themes").alias("n_themes"), F.size("organizations").alias("n_organizations"))


@query("gkg_tiers", f"WITH {GRAPH} SELECT tier AS credibility_tier, count(*) AS n FROM g GROUP BY 1")
def gkg_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news.graph_documents(_graph(spark, sf_dir).where(news.wanted_themes()), ["p_partkey"])
    return rows.groupBy("metadata.credibility_tier").agg(F.count("*").alias("n"))


@query("gkg_priority", f"WITH {GRAPH} SELECT url FROM g ORDER BY tier, published, sha256(url) LIMIT 100")
def gkg_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 in order of tier, time and hash: a top-k report."""
    return news.by_priority(news.graph_documents(_graph(spark, sf_dir).where(news.wanted_themes()), ["p_partkey"])).select("url").limit(100)


@query("page_plain_text", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header\s*>', ' ', 'g'),
  '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x0b]+', ' ', 'g')) AS text FROM pages""")
def page_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query("page_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>')) AS link, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>'), 1) - 1 AS position FROM pages),
b AS (SELECT page_id, position, regexp_extract(link, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS href, regexp_extract(link, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS inside FROM a)
SELECT page_id, position, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://b' || href END AS url, trim(regexp_replace(regexp_replace(inside, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor FROM b WHERE href <> ''""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(table(spark, sf_dir, "pages"), "page_id", "html", "https://b")


@query("noise_removal", r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '\n\s*\n', chr(10) || chr(10), 'g'), '(?is)Last Update:.*?[0-9]{4}', '', 'g'), '^\s+|\s+$', '', 'g')) AS text_hash FROM pages""")
def noise_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("Skip to main content\n \n"), F.col("html"), F.lit("\nStay connected\n a RSS  Last update: May\n 2024 \n"))
    bare = F.regexp_replace(text.without_noise(shown), r"^\s+|\s+$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(bare, 256).alias("text_hash"))


@query("link_statistics", "SELECT source AS section, count(*) AS n_links, strftime(min(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER)), '%Y-%m-%d') AS first_day, strftime(max(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER)), '%Y-%m-%d') AS last_day FROM documents GROUP BY 1")
def link_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd")
    return pages.link_statistics(table(spark, sf_dir, "documents").select(F.col("source").alias("section"), day.alias("day")), "section", "day")


@query("document_filters", """
SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 100 AND source <> '' AND (doc_id % 5 = 0 OR TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')""")
def document_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("doc_id") % 5 > 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600))
    d = table(spark, sf_dir, "documents").where(dedup.present("source", "text") & dedup.between(stamp, "2024-01-05", "2024-01-20", missing=True))
    return d.where(F.length("text") > 100).select("doc_id", F.length("text").alias("n"))


@query("speaker_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(text, 'the')")
def speaker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where((F.col("role") == "user") & F.col("text").contains("the")).select("conv_id", "turn")


@query("type_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("samples_per_type", "SELECT lang, doc_id, length(text) AS n, substr(text, 1, 80) AS shown FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1")
def samples_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_per(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), "lang", ["doc_id"]).select("lang", "doc_id", F.length("text").alias("n"), text.preview(F.col("text")).alias("shown"))


@query("quality_news", f"""WITH {ARTICLES}, n AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 2.0 ELSE 0.5 END AS sentiment_score, CASE WHEN doc_id % 40 = 0 THEN 'odd' ELSE 'neutral' END AS sentiment_label FROM article)
SELECT 'range_sentiment_score' AS rule, count(*) FILTER (sentiment_score > 1) AS violations FROM n UNION ALL SELECT 'domain_sentiment_label', count(*) FILTER (sentiment_label = 'odd') FROM n""")
def quality_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.contracts import NEWS

    a = _articles(spark, sf_dir).withColumns({"sentiment_score": F.when(F.col("_doc_id") % 50 == 0, 2.0).otherwise(0.5), "sentiment_label": F.when(F.col("_doc_id") % 40 == 0, "odd").otherwise("neutral")})
    return quality.checked(a, NEWS).where("violations > 0")


@query("lexicon_sentiment", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}]+') AS words FROM documents),
c AS (SELECT doc_id, len(list_filter(words, lambda x: x IN ('growth', 'gain', 'gains', 'strong', 'improve', 'improved', 'rise', 'rises', 'optimistic', 'recovery', 'boost', 'stable'))) AS good,
             len(list_filter(words, lambda x: x IN ('loss', 'losses', 'weak', 'decline', 'fall', 'falls', 'crisis', 'recession', 'worthless', 'risk', 'risks', 'fear', 'default'))) AS bad FROM w)
SELECT doc_id, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CASE WHEN good > bad THEN round(good / (good + bad)::DOUBLE, 4) WHEN bad > good THEN -round(bad / (good + bad)::DOUBLE, 4) ELSE 0.0 END AS sentiment_score FROM c""")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").select("doc_id", "sentiment_label", "sentiment_score")


@query("linear_sentiment")
def linear_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by what labels teach: toxic texts are negative, others of good quality positive; ids whose crc32 is divisible by 5 are held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    known = known.select("doc_id", F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sentiment.fitted(docs.join(known, "doc_id").where(~held), "text", "label", store=stored)
    return model.score(spread(docs), "text").select("doc_id", held.alias("held_out"), "sentiment_label", "sentiment_score")


@query("document_rows", """
SELECT doc_id, 'ECB' AS source, CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE 'T' || CAST(doc_id AS VARCHAR) END AS title, sha256(CASE WHEN coalesce(toxic, 0) = 1 THEN 'S' || lang ELSE coalesce(text, '') END) AS content_hash,
       coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'en') AS language FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)""")
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    found = d.select(
        F.col("doc_id").alias("DOC_ID"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("Title"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "").otherwise(F.coalesce("text", F.lit(""))).alias("Content"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, F.concat(F.lit("S"), F.col("lang"))).alias("Summary"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("Language"),
    )
    rows = news.document_rows(news.tagged(found, "ECB"), ("doc_id",))
    return rows.select("doc_id", "source", "title", F.sha2("content", 256).alias("content_hash"), "metadata.language")


@query("articles_by_speaker", f"WITH {ARTICLES} SELECT article_id FROM article WHERE contains(speaker, 'A')")
def articles_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.by_speaker(_articles(spark, sf_dir), "A").select("article_id")


def _any_of(column: str, words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


@query("classify_ecb", f"""
WITH t AS (SELECT doc_id, lower(['Monetary policy decision', 'Remarks by A', 'Economic Bulletin 3', 'Annual accounts', ''][doc_id % 5 + 1] || ' ' || coalesce(text, '')) AS t FROM documents),
k AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, '{'|'.join(p)}') THEN '{n}'" for n, p in classify.ECB_PATTERNS.items())} ELSE 'pressreleases' END AS kind FROM t)
SELECT doc_id, kind, CASE WHEN kind = 'pressreleases' THEN 'speeches' ELSE kind END AS section_kind,
       CASE kind WHEN 'pressreleases' THEN 'press_release' WHEN 'speeches' THEN 'speech' WHEN 'policy' THEN 'policy_decision' ELSE 'bulletin' END AS document_type FROM k""")
def classify_ecb(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _pick("doc_id", "Monetary policy decision", "Remarks by A", "Economic Bulletin 3", "Annual accounts", "")
    d = table(spark, sf_dir, "documents").select("doc_id", classify.ecb_type(title, F.col("text")).alias("kind"))
    return d.select("doc_id", "kind", classify.ecb_section_type(F.col("kind"), F.lit("speeches")).alias("section_kind"), classify.ecb_label(F.col("kind")).alias("document_type"))


@query("classify_fed", f"""
WITH t AS (SELECT conv_id, turn, role, lower(['FOMC statement', '', 'Testimony', 'Minutes of June', 'Board announces rule'][turn % 5 + 1] || ' ' || coalesce(text, '')) AS t FROM conversations)
SELECT conv_id, turn, CASE {' '.join(f"WHEN {_any_of('t', w)} THEN '{n}'" for n, w in classify.FED_WORDS.items())} ELSE 'press_release' END AS kind,
       CASE WHEN role = 'user' THEN 'speeches' WHEN turn % 3 = 0 THEN 'policy' WHEN turn % 3 = 1 THEN 'regulation' ELSE 'other' END AS category_kind FROM t""")
def classify_fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _pick("turn", "FOMC statement", "", "Testimony", "Minutes of June", "Board announces rule")
    kind = classify.fed_category_type(_pick("turn", "Monetary Policy", "Enforcement Actions", "Unknown"), F.coalesce(F.col("role") == "user", F.lit(False)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.fed_type(title, F.col("text")).alias("kind"), kind.alias("category_kind"))


@query("classify_boe", """
WITH u AS (SELECT page_id, lower(coalesce(url, '') || ['/Speech/2024/a', '/monetary-policy-summary-and-minutes/x', '/news/2020/y', ''][page_id % 4 + 1]) AS u FROM pages)
SELECT page_id, CASE WHEN contains(u, '/speech/') OR contains(u, '/speeches/') THEN 'speeches' WHEN contains(u, 'monetary-policy-summary') THEN 'summaries' ELSE 'statements' END AS bucket,
       CASE WHEN contains(u, '/speech/') OR contains(u, '/speeches/') THEN 'boe_speech' WHEN contains(u, 'monetary-policy-summary') THEN 'monetary_policy_summary' ELSE 'press_release' END AS kind FROM u""")
def classify_boe(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.coalesce("url", F.lit("")), _pick("page_id", "/Speech/2024/a", "/monetary-policy-summary-and-minutes/x", "/news/2020/y", ""))
    found = table(spark, sf_dir, "pages").select("page_id", classify.boe_type(url).alias("c"))
    return found.select("page_id", F.col("c.bucket").alias("bucket"), F.col("c.type").alias("kind"))


@query("speakers_ecb", r"""
WITH t AS (SELECT doc_id, ['Speech by Anna Maria  Bell at the ', 'Carl Dorn, President of ', '', 'Interview by '][doc_id % 4 + 1] || source || ' ' || substr(coalesce(text, ''), 1, 500) AS t FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(regexp_extract(t, '(?i)(?:speech|remarks|interview|statement)\s+by\s+([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?:\s+at|\s+in|\s+to|\s+for|\s+on|,|$)', 1), '\s+', ' ', 'g')) AS a,
             trim(regexp_replace(regexp_extract(t, '(?i)([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s*,\s*(?:President|Vice-President|Member|Chief))', 1), '\s+', ' ', 'g')) AS b FROM t)
SELECT doc_id, CASE WHEN length(a) BETWEEN 4 AND 49 THEN a WHEN length(b) BETWEEN 4 AND 49 THEN b END AS speaker FROM n""")
def speakers_ecb(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(_pick("doc_id", "Speech by Anna Maria  Bell at the ", "Carl Dorn, President of ", "", "Interview by "), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.ecb_speaker(title, F.col("text")).alias("speaker"))


@query("speakers_fed", r"""
WITH t AS (SELECT conv_id, turn, ['Remarks of Vice Chair ', 'Chairman ', 'On growth: Governor ', ''][turn % 4 + 1] || coalesce(text, '') AS t, ['Vice Chair ', ' Chair ', '', 'member '][turn % 4 + 1] || coalesce(text, '') AS s FROM conversations),
n AS (SELECT *, trim(regexp_extract(t, '(?i)(Vice\s+Chair(?:man)?\s+\w+)', 1)) AS a, trim(regexp_extract(t, '(?i)(Chair(?:man)?\s+\w+)', 1)) AS b, trim(regexp_extract(t, '(?i)(Governor\s+\w+)', 1)) AS c FROM t)
SELECT conv_id, turn, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS title_speaker,
       nullif(trim(regexp_replace(trim(s), '(?i)^(Governor|Chair|Vice Chair|President|Member)\s+', '')), '') AS speaker FROM n""")
def speakers_fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(_pick("turn", "Remarks of Vice Chair ", "Chairman ", "On growth: Governor ", ""), F.coalesce("text", F.lit("")))
    named = F.concat(_pick("turn", "Vice Chair ", " Chair ", "", "member "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.fed_title_speaker(title).alias("title_speaker"), classify.fed_speaker(named).alias("speaker"))


@query("speakers_boe", r"""
WITH t AS (SELECT doc_id, [' Ann Ash ', '', '', ''][doc_id % 4 + 1] AS author, ['x', 'Title' || chr(10) || chr(10) || 'Speech by  Bo Birch' || chr(10) || 'more', 'Title', 'Title'][doc_id % 4 + 1] AS head,
                  coalesce(text, '') || chr(10) || ['', 'speech by Z', 'Intro' || chr(10) || 'a speech by Cy Cedar', 'no one'][doc_id % 4 + 1] AS body FROM documents),
l AS (SELECT doc_id, trim(author) AS author, list_filter(list_filter(list_transform(string_split(head, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:25], lambda x: contains(lower(x), 'speech by '))[1] AS h,
             list_filter(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:80], lambda x: contains(lower(x), 'speech by '))[1] AS m FROM t)
SELECT doc_id, CASE WHEN author <> '' THEN author ELSE coalesce(trim(substr(h, strpos(lower(h), 'speech by ') + 10)), trim(substr(m, strpos(lower(m), 'speech by ') + 10))) END AS speaker FROM l""")
def speakers_boe(spark: SparkSession, sf_dir: str) -> DataFrame:
    author, head = _pick("doc_id", " Ann Ash ", "", "", ""), _pick("doc_id", "x", "Title\n\nSpeech by  Bo Birch\nmore", "Title", "Title")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), _pick("doc_id", "", "speech by Z", "Intro\na speech by Cy Cedar", "no one"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.boe_speaker(author, head, body).alias("speaker"))


@query("url_filter", r"""
WITH u AS (SELECT page_id, coalesce(url, '') || ['/speech/2021/x', '/news/2012/y', '/minutes/z', '/about/2021/', ''][page_id % 5 + 1] AS u, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '/' || CAST(page_id AS VARCHAR) || '.en.html' ELSE 'x/' || CAST(page_id AS VARCHAR) || '.de.html' END AS href FROM pages),
f AS (SELECT *, CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN 'https://b' || href ELSE 'https://b/' || href END AS full_url, regexp_extract(u, '/([0-9]{4})/', 1) AS y,
             contains(u, '/speech/') OR contains(u, '/news/') OR contains(u, '/minutes/') OR contains(u, '/monetary-policy-summary') OR contains(u, '/monetary-policy-committee/') AS wanted FROM u)
SELECT page_id, wanted, wanted AND (y = '' OR CAST(nullif(y, '') AS INTEGER) BETWEEN 2020 AND 2022) AS in_years, full_url AS url, ends_with(full_url, '.en.html') AS english FROM f""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.coalesce("url", F.lit("")), _pick("page_id", "/speech/2021/x", "/news/2012/y", "/minutes/z", "/about/2021/", ""))
    k = F.col("page_id") % 3
    href = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".en.html"))).otherwise(F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".de.html")))
    full = text.absolute_url(href, "https://b")
    return table(spark, sf_dir, "pages").select("page_id", classify.boe_url_wanted(path).alias("wanted"), classify.boe_url_wanted(path, 2020, 2022).alias("in_years"), full.alias("url"), text.is_english_page(full).alias("english"))
