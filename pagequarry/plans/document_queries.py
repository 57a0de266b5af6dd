"""Documents: identity, language, dates, chunks, reads, questions, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import dates as dt
from pagequarry.functions import text as tx
from pagequarry.functions.unicode_forms import nfc_where_needed
from pagequarry.operators import chunking, pages, reading
from pagequarry.plans import inputs as src
from pagequarry.plans.search_queries import query as _query
from pagequarry.session import spread
from pagequarry.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    return _query(oracle, QUERIES, ORACLES)


_KEY = "substr(sha256(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))), 1, 16)"


@query(f"SELECT doc_id, {_KEY.format('nfc_normalize(text)')} AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """content key of every document."""
    docs = spread(src.table(spark, sf, "documents").select("doc_id", "text")).withColumn("nfc", nfc_where_needed(F.col("text")))
    return docs.select("doc_id", tx.content_key(F.col("text"), F.col("nfc")).alias("chunk_id"))


@query(f"""WITH d AS (SELECT doc_id, source, text FROM documents
  UNION ALL SELECT doc_id + 1000000000, source, replace(text, 'é', 'e' || chr(769)) FROM documents)
SELECT {_KEY.format('nfc_normalize(text)')} AS chunk_id, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM d GROUP BY 1""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of every content, also among copies with decomposed accents."""
    base = src.table(spark, sf, "documents").select("doc_id", "source", "text")
    decomposed = base.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "source",
                             F.replace("text", F.lit("é"), F.lit("e\u0301")).alias("text"))
    docs = spread(base.unionByName(decomposed)).withColumn("nfc", nfc_where_needed(F.col("text"))).select(
        F.lit("main").alias("db"), tx.content_key(F.col("text"), F.col("nfc")).alias("chunk_id"), "doc_id", "source")
    return chunking.first_per_chunk(docs, ["doc_id"]).select("chunk_id", "doc_id", "source")


_UPLOADS = "SELECT doc_id, lang, source || '.md' AS filename, sha256(text) AS sha FROM documents"


@query(f"""WITH up AS ({_UPLOADS}), man AS (SELECT DISTINCT sha, filename FROM up WHERE lang = 'en'),
 fresh AS (SELECT sha, min(doc_id) AS ord, arg_min(filename, doc_id) AS filename FROM up WHERE sha NOT IN (SELECT sha FROM man) GROUP BY sha)
SELECT sha AS sha256, CASE WHEN filename IN (SELECT filename FROM man) OR ord <> min(ord) OVER (PARTITION BY filename)
  THEN replace(filename, '.md', '') || '_' || left(sha, 8) || '.md' ELSE filename END AS filename FROM fresh""")
def new_vs_registered(spark: SparkSession, sf: str) -> DataFrame:
    """All documents uploaded where the English ones are registered."""
    uploads = src.table(spark, sf, "documents").select(
        F.regexp_replace("source", "[0-9]+", "").alias("db"), F.col("doc_id").alias("ord"), "lang",
        F.concat("source", F.lit(".md")).alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    manifest = uploads.where("lang = 'en'").select("db", "sha256", "filename").distinct()
    return pages.register(uploads.drop("lang"), manifest).select("sha256", "filename")


@query("""WITH m AS (SELECT DISTINCT source || '.md' AS filename, sha256(text) AS sha256 FROM documents)
SELECT filename, sha256 FROM m WHERE NOT (filename IN (SELECT source || '.md' FROM documents WHERE lang = 'es')
  AND sha256 = (SELECT min(sha256) FROM m o WHERE o.filename = m.filename))""")
def deregister(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the first manifest row of each given name is dropped."""
    docs = src.table(spark, sf, "documents").withColumn("filename", F.concat("source", F.lit(".md"))).withColumn("db", F.lit("main"))
    manifest = docs.select("db", "filename", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).distinct()
    return pages.deregister(manifest, docs.where("lang = 'es'").select("db", "filename").distinct()).select("filename", "sha256")


@query("""WITH e AS (SELECT source || '-' || lang || '.md' AS source, doc_id, text FROM documents)
SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text) AS n FROM e WHERE source NOT LIKE '%-de.md'
 UNION ALL SELECT source, doc_id, length(upper(text || 'ß')) FROM e WHERE source LIKE '%-de.md')""")
def replace_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """K5: rows of the German sources are replaced, all others stay."""
    rows = src.table(spark, sf, "documents").select(
        F.lit("main").alias("db"), F.concat("source", F.lit("-"), "lang", F.lit(".md")).alias("source"), "doc_id", "lang",
        F.length("text").cast("long").alias("n"))
    german = rows.where("lang = 'de'")
    new = german.withColumn("n", F.col("n") + 1)
    return pages.replace_source(rows, new, german.select("db", "source").distinct()).select("source", "doc_id", "n")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING avg(n_chars) > 2500)")
def delete_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """K7: all rows of the sources with the longest documents go."""
    docs = src.table(spark, sf, "documents").withColumn("db", F.lit("main"))
    gone = docs.groupBy("db", "source").agg(F.avg("n_chars").alias("n")).where("n > 2500").select("db", "source")
    return pages.delete_source(docs, gone).select("doc_id", "source")


_DE = "', '".join(fv.VOTE_WORDS["de"])
_EN = "', '".join(fv.VOTE_WORDS["en"])


@query(f"""WITH s AS (SELECT doc_id, lower(left(text, 4000)) AS t FROM documents),
 v AS (SELECT doc_id, len(list_filter(regexp_extract_all(t, '[a-zäöüß]+'), lambda w: w IN ('{_DE}')))
   + CASE WHEN regexp_matches(t, '[äöüß]') THEN 2 ELSE 0 END AS de,
   len(list_filter(regexp_extract_all(t, '[a-zäöüß]+'), lambda w: w IN ('{_EN}'))) AS en FROM s)
SELECT doc_id, CASE WHEN de = en THEN 'de' WHEN de > en THEN 'de' ELSE 'en' END AS voted,
  CASE WHEN de >= en THEN 'Antworte' ELSE 'Answer' END AS directive FROM v""")
def lang_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document by function words."""
    docs = spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tx.vote_language(F.col("text")).alias("voted"),
                       F.substring_index(tx.directive(F.col("text")), " ", 1).alias("directive"))


def _sql_count(t: str, marks) -> str:
    return " + ".join(f"(length({t}) - length(replace({t}, '{m}', ''))) // {len(m)}" for m in marks)


@query(f"""SELECT doc_id, CASE WHEN {_sql_count('t', fv.CHUNK_LANG_MARKERS['de'])} > {_sql_count('t', fv.CHUNK_LANG_MARKERS['en'])}
  THEN 'de' ELSE 'en' END AS lang FROM (SELECT doc_id, lower(left(text, 4000)) AS t FROM documents)""")
def chunk_language(spark: SparkSession, sf: str) -> DataFrame:
    """marker counts in the sample of a document."""
    return src.table(spark, sf, "documents").select("doc_id", tx.chunk_language(F.col("text")).alias("lang"))


# --- dates ------------------------------------------------------------------------------------

_CUE_TEXT = {"1-URGENT": "Das Gesetz ist in Kraft getreten am {dmy}. Stand 01.01.1990",
             "2-HIGH": "Verordnung, gültig ab {iso}. Diese Verordnung ersetzt eine ältere, Fassung vom 31.02.2001",
             "3-MEDIUM": "Fassung vom 31.02.2001 und danach noch einmal geändert, zuletzt vom {dmy}",
             "4-NOT SPECIFIED": "Hinweis: Stand {d}. {month} {y} laut Amt",
             "5-LOW": "Ohne Hinweis, am {dmy} erfasst"}
_MONTH_NAMES = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS effective FROM orders")
def effective_date(spark: SparkSession, sf: str) -> DataFrame:
    """the date of every order recovered from a sentence in one of five forms."""
    d = F.col("o_orderdate")
    parts = {"{dmy}": F.date_format(d, "dd.MM.yyyy"), "{iso}": F.date_format(d, "yyyy-MM-dd"), "{d}": F.date_format(d, "d"),
             "{month}": F.element_at(F.array(*map(F.lit, _MONTH_NAMES)), F.month(d)), "{y}": F.date_format(d, "yyyy")}
    text = F.lit("")
    for priority, sentence in _CUE_TEXT.items():
        filled = F.lit(sentence)
        for name, value in parts.items():
            filled = F.replace(filled, F.lit(name), value)
        text = F.when(F.col("o_orderpriority") == priority, filled).otherwise(text)
    rows = spread(src.table(spark, sf, "orders")).select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", dt.effective_date(F.col("t")).alias("effective"))


# --- chunks ----------------------------------------------------------------------------------------

def _sql_chunks(rules, legal: bool) -> str:
    """The chunker in SQL: line windows for sections, a recursive CTE for packing, islands for merging."""
    head = r"'^#{1,4}\s*§\s*\d+[a-z]?($|[^\p{L}\p{N}_])'" if legal else r"'^#{2,4}\s+\S'"
    title = (r"trim(regexp_extract(line, '^#{1,4}\s*§\s*\d+[a-z]?(.*)$', 1))" if legal else r"trim(regexp_extract(line, '^#+\s+(.*)$', 1))")
    anchor = r"'§ ' || regexp_extract(line, '^#{1,4}\s*§\s*(\d+[a-z]?)', 1)" if legal else title
    path = (f"{anchor} || CASE WHEN {title} <> '' THEN ' ' || {title} ELSE '' END" if legal else
            "concat_ws('|', CASE WHEN lv > 2 THEN t2 END, CASE WHEN lv > 3 AND n3 > coalesce(n2, 0) THEN t3 END, title)")
    keep = "HAVING sum(CASE WHEN h THEN 1 ELSE 0 END) >= 3" if legal else "HAVING true"
    return f"""WITH RECURSIVE md AS (SELECT doc_id, {src.sql_markup('text', rules)} AS body FROM documents),
 ln AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n
    FROM md WHERE regexp_matches(body, '\\S')),
 hd AS (SELECT *, regexp_matches(line, {head}) AS h FROM ln),
 fit AS (SELECT doc_id FROM hd GROUP BY doc_id {keep}),
 pos AS (SELECT *, coalesce(sum(length(line) + 1) OVER w, 0) AS start, CASE WHEN h THEN length(regexp_extract(line, '^(#+)', 1)) END AS lv,
    CASE WHEN h THEN {title} END AS title FROM hd SEMI JOIN fit USING (doc_id)
    WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 lvl AS (SELECT *, last_value(CASE WHEN lv = 2 THEN title END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN lv = 2 THEN n END IGNORE NULLS) OVER w AS n2,
    last_value(CASE WHEN lv = 3 THEN title END IGNORE NULLS) OVER w AS t3, last_value(CASE WHEN lv = 3 THEN n END IGNORE NULLS) OVER w AS n3
    FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 cut AS (SELECT doc_id, start, {anchor} AS anchor, {path} AS path FROM lvl WHERE h
    UNION ALL SELECT doc_id, 0, CASE WHEN doc_id IN (SELECT doc_id FROM hd WHERE h) THEN '{"Präambel" if legal else "Preamble"}' ELSE '' END, ''
    FROM fit WHERE doc_id NOT IN (SELECT doc_id FROM hd WHERE h AND n = 1)),
 sec AS (SELECT *, body[CAST(start + 1 AS BIGINT):CAST(fin AS BIGINT)] AS txt FROM (SELECT c.*, m.body,
    lead(start, 1, length(m.body)) OVER (PARTITION BY doc_id ORDER BY start) AS fin FROM cut c JOIN md m USING (doc_id))),
 good AS (SELECT * FROM sec WHERE anchor NOT IN ('Preamble', 'Präambel') OR start > 0 OR length(regexp_replace(txt, '^\\s+|\\s+$', '', 'g')) >= 80),
 par AS (SELECT doc_id, start, anchor, path, ps, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p) + 2))) AS ends
    FROM (SELECT *, regexp_split_to_array(txt, '\\n\\s*\\n') AS ps FROM good WHERE length(txt) > 4000)),
 win AS (SELECT doc_id, start, anchor, path, ps, ends, 0 AS a, greatest(1, len(list_filter(ends, lambda e: e <= 4000))) AS b, start AS pos0, 1 AS part FROM par
    UNION ALL
    SELECT doc_id, start, anchor, path, ps, ends, tail, greatest(b + 1, len(list_filter(ends, lambda e: e - coalesce(ends[tail], 0) <= 4000))),
      pos0 + (ends[b] - coalesce(ends[a], 0) - 2) - (ends[b] - coalesce(ends[tail], 0)), part + 1
    FROM (SELECT *, greatest(a, len(list_filter(range(0, b), lambda j: coalesce(ends[j], 0) <= ends[b] - 300)) - 1) AS tail FROM win) t WHERE b < len(ps)),
 pieces AS (SELECT doc_id, start, 1 AS part, start AS pos0, anchor, path, regexp_replace(txt, '^\\s+|\\s+$', '', 'g') AS txt FROM good WHERE length(txt) <= 4000
    UNION ALL SELECT doc_id, start, part, pos0, CASE WHEN anchor <> '' AND (part > 1 OR b < len(ps)) THEN anchor || ' (Teil ' || part || ')'
       WHEN anchor = '' AND b < len(ps) THEN 'part ' || part ELSE anchor END, path,
       regexp_replace(array_to_string(ps[a + 1:b], chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g') FROM win),
 num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, part) AS rn FROM pieces),
 grp AS (SELECT *, sum(CASE WHEN rn = 1 OR length(txt) >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS g FROM num),
 out AS (SELECT doc_id, g, arg_min(anchor, rn) AS anchor, arg_min(path, rn) AS path, arg_min(pos0, rn) AS char_start,
    arg_max(pos0 + length(txt), rn) AS char_end, string_agg(txt, chr(10) || chr(10) ORDER BY rn) AS txt FROM grp GROUP BY ALL)
SELECT 'doc-' || doc_id || '.md' AS source, CAST(g - 1 AS BIGINT) AS seq, {_KEY.format('txt')} AS chunk_id, anchor, path AS heading_path,
  CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, CAST(length(txt) AS BIGINT) AS n_chars FROM out"""


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    long = [F.col(c).cast("long").alias(c) for c in ("seq", "char_start", "char_end")]
    return chunks.select("source", *long, "chunk_id", "anchor", F.array_join("heading_path", "|").alias("heading_path"),
                         F.length("text").cast("long").alias("n_chars"))


@query(_sql_chunks(src.MARKDOWN_RULES, legal=False))
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as Markdown, cut at its headings, packed, short chunks joined."""
    return _chunk_rows(chunking.split_documents(spread(src.documents_as(spark, sf, src.markdown))))


@query(_sql_chunks(src.LEGAL_RULES, legal=True))
def legal_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with at least three paragraph headings, cut at them."""
    docs = spread(src.documents_as(spark, sf, src.legal_markdown))
    return _chunk_rows(chunking.split_documents(docs.where(chunking.is_legal(F.col("text")))))


@query()
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable chunks of one page per document."""
    rows = src.table(spark, sf, "documents").select(
        F.lit("main").alias("db"), F.concat(F.lit("page-"), "doc_id", F.lit(".md")).alias("filename"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"), src.markdown(F.col("text")).alias("body"))
    return chunking.page_chunks(spread(rows)).select("source", "chunk_id", "anchor", "scope", F.length("text").alias("n_chars"))


_PIECE = """CASE WHEN length(rest) <= 40000 THEN length(rest) WHEN strpos(reverse(left(rest, 40000)), chr(10) || chr(10)) BETWEEN 1 AND 39998
  THEN 40001 - strpos(reverse(left(rest, 40000)), chr(10) || chr(10)) ELSE 40000 END"""


@query(f"""WITH RECURSIVE p AS (SELECT 'doc-' || doc_id || '.md' AS source, CAST(0 AS BIGINT) AS piece,
   repeat(CASE WHEN lang = 'de' THEN text ELSE replace(text, chr(10), chr(10) || chr(10)) END, 12) AS rest FROM documents
 UNION ALL SELECT source, piece + 1, substr(rest, {_PIECE} + 1) FROM p WHERE length(rest) > {_PIECE})
SELECT source, piece, CAST({_PIECE} AS BIGINT) AS n_chars, md5(left(rest, {_PIECE})) AS digest FROM p""")
def synthesis_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """long documents, with and without blank lines, cut into pieces of at most 40,000 characters."""
    blank_lines = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = src.table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("source"), F.repeat(blank_lines, 12).alias("text"))
    cut = chunking.synthesis_pieces(docs)
    return cut.select("source", F.col("piece").cast("long").alias("piece"), F.length("piece_text").cast("long").alias("n_chars"),
                      F.md5("piece_text").alias("digest"))


@query("""SELECT doc_id, CAST(least(length(text), 16000) AS BIGINT) AS end_at, CAST(length(text) AS BIGINT) AS total,
  left(text, 16000) AS w, CASE WHEN length(text) > 16000 THEN '…[truncated; pass offset=16000 to continue]' ELSE '' END AS footer FROM documents""")
def read_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The first window of every raw text."""
    docs = src.documents_as(spark, sf, lambda t: t)
    out = reading.read_window(docs, F.lit(0))
    return out.select(F.regexp_extract("source", r"\d+", 0).cast("long").alias("doc_id"), F.col("end").cast("long").alias("end_at"),
                      F.col("total").cast("long").alias("total"), F.col("window").alias("w"), "footer")


@query("""SELECT doc_id, CAST(o AS BIGINT) AS start, CASE WHEN o < length(text) THEN CAST(least(length(text), o + 16000) AS BIGINT) END AS end_at, substr(text, o + 1, 16000) AS w,
  CASE WHEN o >= length(text) THEN '(offset past end)' WHEN o + 16000 < length(text) THEN '…[truncated; pass offset=' || (o + 16000) || ' to continue]'
    WHEN o > 0 THEN '…[end of file]' ELSE '' END AS footer FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1, 16000)) AS o FROM documents)""")
def read_all_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every window of every raw text, as a reader that follows the footers gets them."""
    docs = src.documents_as(spark, sf, lambda t: t).withColumn("offset", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(16000))))
    out = reading.read_window(docs, F.col("offset"))
    return out.select(F.regexp_extract("source", r"\d+", 0).cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"),
                      F.col("end").cast("long").alias("end_at"), F.col("window").alias("w"), "footer")


_MENU = """WITH l AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS n
   FROM (SELECT doc_id, {md} AS b FROM documents)),
 a AS (SELECT doc_id, trim(regexp_extract(line, '^#{{2,4}}\\s+(.*)$', 1)) AS anchor, min(n) AS n FROM l
   WHERE regexp_matches(line, '^#{{2,4}}\\s+\\S') GROUP BY ALL)
SELECT 'doc-' || doc_id || '.md' AS source, anchor, lead(anchor) OVER (PARTITION BY doc_id ORDER BY n) AS next_anchor FROM a""".format(
    md=src.sql_markup("text", src.MARKDOWN_RULES))


def _section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections before packing and joining, as chunk rows."""
    cut = chunking.section_rows(spread(src.documents_as(spark, sf, src.markdown)).select("db", "source", "text"))
    return cut.select("db", "source", F.posexplode("sections").alias("seq", "s")).select(
        "db", "source", "seq", F.col("s.anchor").alias("anchor"), F.concat("source", F.lit("#"), "seq").alias("chunk_id"), "s.text")


@query(_MENU)
def section_menu(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct anchors of every document and the one that follows."""
    cut = _section_chunks(spark, sf).where("anchor <> 'Preamble'")
    return reading.section_menu(cut).select("source", "anchor", "next_anchor")


@query(_MENU.split("SELECT 'doc-'")[0] + """, r AS (SELECT doc_id, arg_max(anchor, n) AS last FROM a GROUP BY doc_id)
SELECT 'doc-' || r.doc_id || '.md' AS source, anchor FROM r JOIN a USING (doc_id)
WHERE starts_with(lower(anchor), lower(trim(left(last, 3)))) OR starts_with(lower(trim(left(last, 3))), lower(anchor))
QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY CASE WHEN lower(anchor) = lower(trim(left(last, 3))) THEN 0 ELSE 1 END, n) = 1""")
def resolve_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The first three letters of the last anchor of every document, resolved by prefix."""
    cut = _section_chunks(spark, sf).where("anchor not in ('Preamble', '')")
    firsts = cut.groupBy("db", "source", "anchor").agg(F.min("seq").alias("seq"))
    last = firsts.groupBy("db", "source").agg(F.max_by("anchor", "seq").alias("last"))
    asked = last.select(F.col("source").alias("request_id"), "db", "source", F.concat(F.lit("# "), F.left("last", F.lit(3))).alias("section"))
    return reading.resolve_sections(cut, asked).select("source", "anchor")


@query("""SELECT 'doc-' || doc_id || '.md' AS source, left(coalesce(CASE WHEN len(h) > 0 THEN trim(ltrim(h[1], '# ')) ELSE ls[1] END, ''), 100) AS hint
 FROM (SELECT *, list_filter(ls, lambda s: starts_with(s, '#')) AS h FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
   lambda s: trim(s)), lambda s: s <> '' AND NOT starts_with(s, '<')) AS ls FROM documents))""")
def raw_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Name and first heading or prose line of every raw file."""
    return reading.raw_listing(src.documents_as(spark, sf, lambda t: t)).select("source", "hint")


@query(f"""WITH t AS {src.sql_terms('documents', 'doc_id')}, d AS (SELECT doc_id, count(DISTINCT term) AS density FROM t WHERE NOT contains(term, '⁄') GROUP BY 1),
 r AS (SELECT source || '.md' AS source, doc_id, coalesce(density, 0) AS density, length(text) AS n, lang IN ('de', 'fr') AS anchored FROM documents LEFT JOIN d USING (doc_id))
SELECT source, doc_id, density, CAST(row_number() OVER (PARTITION BY source ORDER BY anchored DESC, density DESC, n DESC, doc_id) AS BIGINT) AS rank
FROM r QUALIFY rank <= 5""")
def question_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The five densest documents of every collection."""
    chunks = src.table(spark, sf, "documents").select(
        F.lit("main").alias("db"), F.concat("source", F.lit(".md")).alias("source"), F.col("doc_id").alias("seq"),
        F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("lang") == "de", "§ 1").otherwise("").alias("anchor"),
        F.when(F.col("lang") == "fr", F.array(F.lit("Doc"))).otherwise(F.array().cast("array<string>")).alias("heading_path"),
        F.lit(0).alias("char_start"), "text")
    return reading.question_targets(chunks).select("source", F.col("seq").alias("doc_id"), "density", F.col("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN true ELSE false END AS ok FROM conversations),
 v AS (SELECT conv_id, turn, text AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM q WHERE ok QUALIFY n <= 5)
SELECT 'conv_' || conv_id || '.md' AS source, trim(question, ' ' || chr(10)) AS question FROM v WHERE trim(question, ' ' || chr(10)) <> ''
UNION ALL SELECT 'conv_' || conv_id || '.md', 'Worum geht es in conv ' || conv_id || '?' FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM v) GROUP BY conv_id""")
def generated_questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as a model's questions; conversations without any get one by name."""
    conv = src.table(spark, sf, "conversations").withColumn("source", F.concat(F.lit("conv_"), "conv_id", F.lit(".md")))
    targets = conv.groupBy("source").agg(F.min("turn").alias("rank")).select(
        F.lit("main").alias("db"), "source", F.lit("c").alias("chunk_id"), F.lit(1).alias("rank"))
    answers = conv.select(F.lit("main").alias("db"), "source", F.when(F.col("role") == "user", "c").otherwise("unknown").alias("chunk_id"),
                          F.col("turn").alias("pos"), F.col("text").alias("question"))
    return reading.generated_questions(targets, answers).select("source", "question")


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text nodes of every web page."""
    return spread(src.table(spark, sf, "pages")).select("page_id", files.html_text("html").alias("text"))


@query()
def web_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as Markdown."""
    return files.web_pages(spread(src.table(spark, sf, "pages").select("url", "html")))


@query("""SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  lower(regexp_extract(url, '(\\.[^./?#]+)$', 1)) IN ('.pdf', '.docx', '.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp') AS convertible FROM pages""")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Slug of every address and its format test."""
    return src.table(spark, sf, "pages").select("url", tx.slug(F.col("url")).alias("slug"), files.is_convertible(F.col("url")).alias("convertible"))
