"""The engine's operators as queries over the documents table, each with its SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, text
from .operators import gaps
from .operators.index import Index, segments, terms_of_segment, tokenize
from .operators.search import Searcher
from .sources.library import from_table, ranked, read_library, shared_folder, spread

_indexes: dict[tuple[str, str], Index] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(from_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """One index a folder and application; its tables are made when first used, and kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = Index.build(from_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return _indexes[key]


def joined(column: str, name: str) -> object:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(name)


# SQL that every oracle starts from: documents, tokens, postings and vocabulary.
_DOCS = "docs AS (SELECT doc_id, 'doc' || doc_id AS name, text FROM documents)"
_TOKENS = f"""l AS (SELECT doc_id, {text.terms_sql('text', True)} AS t FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM l)"""
_POSTINGS = "postings AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY term, doc_id)"
_VOCAB = "vocab AS (SELECT term, reverse(term) AS rev_term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term)"


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_DOCS, _TOKENS, _POSTINGS, _VOCAB, *more])} {body}"


def _ids(where: str) -> str:
    return f"SELECT doc_id FROM postings WHERE {where}"


def _has(term: str) -> str:
    return f"({_ids(f'term = {term!r}')})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLE[name or f.__name__] = oracle
        return f

    return put


# Sources and registry


@query("SELECT doc_id, 'doc' || doc_id AS name, CAST(length(text) AS BIGINT) AS chars FROM documents")
def corpus_scan(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "name", F.length("text").cast("long").alias("chars"))


@query("SELECT name, row_number() OVER (ORDER BY name) - 1 AS rank FROM (SELECT 'doc' || doc_id AS name FROM documents)")
def doc_registry(spark, sf_dir):
    return ranked(corpus(spark, sf_dir).select("name"), "name", "rank")


@query("SELECT doc_id, 'doc' || doc_id AS name FROM documents")
def doc_name(spark, sf_dir):
    return index(spark, sf_dir).docs.select("doc_id", "name")


@query("SELECT page_id AS doc_id, url AS path, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def doc_path(spark, sf_dir):
    """Paths and base names, of a corpus whose documents have some."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return from_table(pages, "page_id", "html", "url").select("doc_id", "path", "name")


@query("SELECT row_number() OVER (ORDER BY f) - 1 AS doc_id, f AS name, CAST(chars AS BIGINT) AS chars FROM (SELECT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS f, sum(length(text) + 1) AS chars FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13)) GROUP BY 1)")
def folder_scan(spark, sf_dir):
    """A folder of text files, one a language, written and scanned: ids follow the paths."""
    folder = f"{shared_folder(spark)}/folder-{os.urandom(8).hex()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and not contains(text, chr(13))")
    docs.select("lang", "text").write.partitionBy("lang").text(folder)
    found = read_library(spark, folder).select(F.element_at(F.split("path", "/"), -2).alias("name"), F.length("text").alias("n"))
    found = ranked(found.groupBy("name").agg(F.sum("n").cast("long").alias("chars")), "name", "doc_id").select("doc_id", "name", "chars").persist()
    found.count()
    Index.delete(spark, folder)
    return found


# Text functions


@query(f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{text.SPACE}'), lambda x: x <> '')) AS BIGINT) AS n FROM documents")
def tokenize_raw(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", text.SPACE), lambda x: x != "")).cast("long").alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({text.terms_sql('text', True, stem=False, accept=False)}) AS term FROM documents) GROUP BY term")
def normalize_terms(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.explode(text.terms(stem=False, accept=False)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT term, {text.stem_sql('term', True)} AS stem FROM (SELECT DISTINCT unnest({text.terms_sql('text', True, stem=False, accept=False)}) AS term FROM documents)")
def stem_terms(spark, sf_dir):
    found = corpus(spark, sf_dir).select(F.explode(text.terms(stem=False, accept=False)).alias("term")).distinct()
    return found.select("term", F.expr(text.stem_sql("term")).alias("stem"))


@query(f"SELECT doc_id, CAST(len({text.terms_sql('text', True)}) AS BIGINT) AS accepted, CAST(len({text.terms_sql('text', True, accept=False)}) AS BIGINT) AS words FROM documents")
def accept_filter(spark, sf_dir):
    words = corpus(spark, sf_dir).select("doc_id", text.terms(accept=False).alias("w"))
    return words.select("doc_id", F.size(text.accepted("w")).cast("long").alias("accepted"), F.size("w").cast("long").alias("words"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({text.terms_sql('text', True, accept=False)}) AS term FROM documents) WHERE NOT ({text.accept_sql('term', True)}) GROUP BY term")
def dropped_codes(spark, sf_dir):
    found = corpus(spark, sf_dir).select(F.explode(text.terms(accept=False)).alias("term"))
    return found.where(f"not ({text.accept_sql('term')})").groupBy("term").agg(F.count("*").alias("n"))


@query(sql("SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tokens"))
def token_positions(spark, sf_dir):
    return tokenize(corpus(spark, sf_dir))


# Index tables


@query(sql("SELECT term, doc_id, CAST(tf AS INTEGER) AS tf FROM postings"))
def postings_tf(spark, sf_dir):
    return index(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query(sql("SELECT term, doc_id, array_to_string(positions, ' ') AS places FROM postings"))
def positional_postings(spark, sf_dir):
    return index(spark, sf_dir).postings.select("term", "doc_id", joined("positions", "places"))


@query(sql("SELECT doc_id, count(*) AS distinct_terms, CAST(sum(tf) AS BIGINT) AS total, CAST(max(tf) AS INTEGER) AS top FROM postings GROUP BY doc_id"))
def partial_final_merge(spark, sf_dir):
    return index(spark, sf_dir).postings.groupBy("doc_id").agg(F.count("*").alias("distinct_terms"), F.sum("tf").cast("long").alias("total"), F.max("tf").alias("top"))


@query(sql("SELECT term, df, cf FROM vocab"))
def vocab_df(spark, sf_dir):
    return index(spark, sf_dir).vocab.select("term", "df", "cf")


@query(sql("SELECT term FROM vocab"))
def vocab_scan(spark, sf_dir):
    return index(spark, sf_dir).terms()


@query(sql("SELECT term, row_number() OVER (ORDER BY term) - 1 AS rank FROM vocab"))
def term_rank(spark, sf_dir):
    return index(spark, sf_dir).ranks()


@query(sql("SELECT rev_term, row_number() OVER (ORDER BY rev_term) - 1 AS rank FROM vocab"))
def reverse_dictionary(spark, sf_dir):
    return ranked(index(spark, sf_dir).vocab.select("rev_term"), "rev_term", "rank")


@query(sql("SELECT t AS term, t IN (SELECT term FROM vocab) AS present FROM (VALUES ('the'), ('of'), ('absentword')) x(t)"))
def contains_term(spark, sf_dir):
    i = index(spark, sf_dir)
    return spark.createDataFrame([(t, i.contains(t)) for t in ("the", "of", "absentword")], "term string, present boolean")


@query(sql("SELECT doc_id FROM postings WHERE term = 'der'"))
def get_postings(spark, sf_dir):
    return index(spark, sf_dir).get_postings("der")


@query(sql("SELECT doc_id, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ' ') AS places FROM postings WHERE term = 'la'"))
def get_term_data(spark, sf_dir):
    return index(spark, sf_dir).get_term_data("la").select("doc_id", "tf", joined("positions", "places"))


@query(sql("SELECT term FROM vocab WHERE starts_with(term, 'than')"))
def prefix_terms(spark, sf_dir):
    return index(spark, sf_dir).starts_with("than")


@query(sql("SELECT term FROM vocab WHERE ends_with(term, 'ing')"))
def suffix_terms(spark, sf_dir):
    return index(spark, sf_dir).ends_with("ing")


# Codecs

_GAPS = "g AS (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM postings)"


def _doc_gaps(spark, sf_dir) -> DataFrame:
    return gaps.encode_blocks(index(spark, sf_dir).blocked)


@query(sql("SELECT term, doc_id, gap FROM g", _GAPS))
def doc_gaps(spark, sf_dir):
    return _doc_gaps(spark, sf_dir).select("term", "doc_id", "gap")


_ALL_POS_GAPS = "apg AS (SELECT term, doc_id, pos - lag(pos, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY pos) AS gap, pos FROM tokens)"


@query(sql("SELECT term, doc_id, string_agg(CAST(gap AS VARCHAR), ' ' ORDER BY pos) AS gaps FROM apg GROUP BY term, doc_id", _ALL_POS_GAPS))
def pos_gaps(spark, sf_dir):
    return index(spark, sf_dir).postings.select("term", "doc_id", F.array_join(F.transform(codec.gaps(F.col("positions")), lambda x: x.cast("string")), " ").alias("gaps"))


@query(sql("SELECT term, doc_id, CAST(sum(gap) OVER (PARTITION BY term ORDER BY doc_id) AS BIGINT) AS decoded FROM g", _GAPS))
def gap_decode(spark, sf_dir):
    return gaps.decode_blocks(_doc_gaps(spark, sf_dir))


_SIZE = "CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END"


def _duck_hex() -> str:
    byte = lambda k: f"upper(lpad(printf('%x', CAST(((n >> {7 * k}) & 127) + {128 if k == 0 else 0} AS BIGINT)), 2, '0'))"
    return " || ".join(f"CASE WHEN {_SIZE} > {k} THEN {byte(k)} ELSE '' END" for k in (4, 3, 2, 1, 0))


# What an index encodes: the document gaps, frequencies and position gaps of all postings.
_CODED = "n AS (SELECT CAST(gap AS BIGINT) AS n FROM g UNION SELECT CAST(tf AS BIGINT) FROM postings UNION SELECT CAST(gap AS BIGINT) FROM apg)"


def _coded(spark, sf_dir) -> DataFrame:
    postings = index(spark, sf_dir).postings
    inner = postings.select(F.explode(F.concat(F.array(F.col("tf").cast("long")), F.transform(codec.gaps(F.col("positions")), lambda x: x.cast("long")))).alias("n"))
    return inner.union(_doc_gaps(spark, sf_dir).select(F.col("gap").cast("long"))).distinct()


@query(sql(f"SELECT n, {_SIZE} AS bytes FROM n", _GAPS, _ALL_POS_GAPS, _CODED))
def vlc_size(spark, sf_dir):
    return _coded(spark, sf_dir).select("n", codec.vlc_size(F.col("n")).alias("bytes"))


@query(sql(f"SELECT n, {_duck_hex()} AS code FROM n", _GAPS, _ALL_POS_GAPS, _CODED))
def vlc_hex(spark, sf_dir):
    return _coded(spark, sf_dir).select("n", codec.vlc_hex(F.col("n")).alias("code"))


@query(sql("SELECT n, n AS decoded FROM n", _GAPS, _ALL_POS_GAPS, _CODED))
def vlc_roundtrip(spark, sf_dir):
    return _coded(spark, sf_dir).select("n", codec.vlc_decode(codec.vlc_hex(F.col("n"))).alias("decoded"))


_BYTES = f"""SELECT term, CAST(4 + sum(bytes) AS BIGINT) AS bytes FROM (
SELECT term, sum({_SIZE}) AS bytes FROM (SELECT term, gap AS n FROM g) GROUP BY term UNION ALL
SELECT term, sum({_SIZE}) FROM (SELECT term, tf AS n FROM postings) GROUP BY term UNION ALL
SELECT term, sum({_SIZE}) FROM (SELECT term, gap AS n FROM apg) GROUP BY term) GROUP BY term"""


@query(sql(_BYTES, _GAPS, _ALL_POS_GAPS))
def index_bytes(spark, sf_dir):
    """Bytes of a term's postings, coded: four for its number of documents, then document gaps, frequencies and position gaps."""
    size = lambda n: codec.vlc_size(n).cast("long")
    places = F.aggregate(codec.gaps(F.col("positions")), F.lit(0).cast("long"), lambda a, x: a + size(x))
    inner = index(spark, sf_dir).postings.groupBy("term").agg(F.sum(size(F.col("tf")) + places).alias("bytes"))
    gap = _doc_gaps(spark, sf_dir).groupBy("term").agg(F.sum(size(F.col("gap"))).alias("bytes"))
    return inner.unionAll(gap).groupBy("term").agg((F.sum("bytes") + 4).alias("bytes"))


_SEGMENT = """SELECT CAST(greatest(row_number() OVER (ORDER BY term) - 2, 0) // (1 + (SELECT CAST(sum(b) AS BIGINT) // 3 // 5 FROM (
SELECT strlen(coalesce(text, '')) AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), unnest([0, n // 2, n - 1]) AS x(k) WHERE i = k)) AS BIGINT) AS segment, term FROM vocab"""


@query(sql(_SEGMENT))
def segment_cut(spark, sf_dir):
    return segments(index(spark, sf_dir).ranks(), terms_of_segment(corpus(spark, sf_dir)))


# Query modes


def _search(name: str, mode: str, q: str, where: str, more: str = "") -> None:
    oracle = sql(f"SELECT doc_id, name FROM docs WHERE doc_id IN ({where})", *([more] if more else []))
    query(oracle, name)(lambda spark, sf_dir: getattr(Searcher(index(spark, sf_dir)), mode)(q))


def _count(name: str, mode: str, q: str, where: str = "SELECT doc_id FROM docs WHERE false") -> None:
    """Without `where`, the query's grammar alone makes it empty."""
    query(sql(f"SELECT count(*) AS n FROM docs WHERE doc_id IN ({where})"), name)(lambda spark, sf_dir: getattr(Searcher(index(spark, sf_dir)), mode)(q).agg(F.count("*").alias("n")))


_search("boolean_and", "boolean", "the AND of", f"{_has('the')} INTERSECT {_has('of')}")
_search("boolean_or", "boolean", "la OR der", f"{_has('la')} UNION {_has('der')}")
_search("boolean_not", "boolean", "the AND NOT of", f"{_has('the')} EXCEPT {_has('of')}")
_search("boolean_dnf", "boolean", "the AND of OR de AND NOT la", f"({_has('the')} INTERSECT {_has('of')}) UNION ({_has('de')} EXCEPT {_has('la')})")
_count("boolean_not_only", "boolean", "NOT the")
_count("boolean_unknown", "boolean", "the AND absentword", f"{_has('the')} INTERSECT {_has('absentword')}")
_count("boolean_glued", "boolean", "the of", _has("theof"))
_search("boolean_inword_operator", "boolean", "thORde", f"{_has('th')} UNION {_has('de')}")


def _pair(a: str, b: str, k: int) -> str:
    return f"(SELECT x.doc_id FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND abs(x.pos - y.pos) <= {k} WHERE x.term = '{a}' AND y.term = '{b}')"


_search("positional_pair", "positional", "the /2 of", _pair("the", "of", 2))
_search("positional_chain", "positional", "the /1 of /3 and", f"{_pair('the', 'of', 1)} UNION {_pair('of', 'and', 3)}")
_search("positional_wide", "positional", "la /20 de", _pair("la", "de", 20))
_count("positional_zero", "positional", "the /0 of", _pair("the", "of", 0))
_search("positional_self", "positional", "der /0 der", _has("der"))
_count("positional_single", "positional", "the")
_count("positional_unknown", "positional", "the /1 absentword", _pair("the", "absentword", 1))

_TH, _AN_ING, _VER = "starts_with(term, 'th')", "starts_with(term, 'an') AND ends_with(term, 'ing')", "starts_with(term, 'ver')"
_search("joker_prefix", "joker", "than*", _ids("starts_with(term, 'than')"))
_search("joker_suffix", "joker", "*heit", _ids("ends_with(term, 'heit')"))
_search("joker_infix", "joker", "th*ing", _ids("starts_with(term, 'th') AND ends_with(term, 'ing')"))
_search("joker_two_star", "joker", "th*on*ed", _ids("starts_with(term, 'th') AND ends_with(term, 'ed') AND contains(term, 'on')"))
_search("joker_overlap", "joker", "the*the", _ids("starts_with(term, 'the') AND ends_with(term, 'the')"))
_search("joker_multi", "joker", "th* an*ing", f"({_ids(_TH)}) INTERSECT ({_ids(_AN_ING)})")
_search("joker_leading_plain", "joker", "absentword ver*", _ids(_VER))
_search("joker_plain_after", "joker", "ver* der", f"({_ids(_VER)}) INTERSECT {_has('der')}")
_count("joker_plain_only", "joker", "the of")
_search("joker_rebase", "joker", "ver* absentword ment*", _ids("starts_with(term, 'ment')"))
_count("joker_bad_grammar", "joker", "*th*")


@query(sql("SELECT term, df, cf, (SELECT count(*) FROM postings) AS n_postings, (SELECT count(*) FROM documents) AS n_docs FROM vocab"))
def save_load_roundtrip(spark, sf_dir):
    """Stored, found, loaded, and deleted once its rows are kept."""
    path = f"{shared_folder(spark)}/index-{os.urandom(8).hex()}"
    index(spark, sf_dir).save(path)
    if not Index.present(spark, path):
        raise RuntimeError("the stored index is not whole")
    stored = Index.load(spark, path)
    counts = F.lit(stored.postings.count()).alias("n_postings"), F.lit(stored.docs.count()).alias("n_docs")
    out = stored.vocab.select("term", "df", "cf", *(c.cast("long").alias(n) for c, n in zip(counts, ("n_postings", "n_docs"), strict=True))).persist()
    out.count()
    Index.delete(spark, path)
    if Index.present(spark, path):
        raise RuntimeError("the index is still there")
    return out
