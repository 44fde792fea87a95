"""The queries of the training-data problems (p4, p6, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.cutting import cut
from quillspan.llm.mixing import Mix
from quillspan.llm.neardup import NearDuplicates
from quillspan.llm.packing import pack, sized
from quillspan.llm.termfreq import marked_terms
from quillspan.names import file_of, file_sql, name_of, name_sql
from quillspan.session import Scratch, table


def alike(spark: SparkSession, d: str) -> NearDuplicates:
    blocks = table(spark, d, "blocks").select("block_key", F.coalesce("sas_code", "sas_text").alias("text"))
    return NearDuplicates(blocks, "block_key", "text", k=3, t=0.7)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return alike(spark, d).pairs().select(F.col("key_a").alias("block_key_a"), F.col("key_b").alias("block_key_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each block with its class of equal sets, the copies in it and the links of the class."""
    return alike(spark, d).classes().withColumnsRenamed({"key": "block_key", "class_key": "class_block_key"})


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate texts of documents: runs of five words, similarity of at least 0.8."""
    return NearDuplicates(table(spark, d, "documents"), "doc_id", "text").classes().withColumnsRenamed({"key": "doc_id", "class_key": "class_doc_id"})


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Which classes of p4_documents are near-duplicates of which, and how alike they are."""
    found = NearDuplicates(table(spark, d, "documents"), "doc_id", "text").class_links()
    return found.withColumnsRenamed({"class_a": "class_doc_id_a", "class_b": "class_doc_id_b"})


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mentions").select(name_of("term").alias("term"), file_of("fileid").alias("fileid"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(mentions(spark, d), "term", "fileid").filter("mark is not null").select("term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms with how often and in how many files they occur."""
    return marked_terms(mentions(spark, d), "term", "fileid").select("term", "n", F.col("n_records").alias("n_files"), "mark")


def limits(spark: SparkSession, d: str, prefix: str) -> list[tuple[str, int, int]]:
    """The limits of a kind; the table has one row per limit and does not grow."""
    return sorted((r.limit_name, r.max_tokens, r.overlap_tokens) for r in table(spark, d, "size_limits").filter(F.col("limit_name").startswith(prefix)).collect())


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where each piece of each text goes, per pack limit."""
    scratch = Scratch(spark, "pack")
    sizes = scratch.write(sized(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    parts = [pack(sizes, most, scratch).select(F.lit(name).alias("limit_name"), "container", F.col("key").alias("doc_id"), "piece", "start_token", "n_tokens") for name, most, _ in limits(spark, d, "pack_")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room used, per pack limit."""
    used = p7_containers(spark, d).filter("container is not null").groupBy("limit_name", "container").agg(F.sum("n_tokens").alias("n"))
    cap = table(spark, d, "size_limits").select("limit_name", "max_tokens")
    return used.groupBy("limit_name").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")).join(cap, "limit_name").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens")))


def targets(spark: SparkSession, d: str) -> list[tuple[str, float, int]]:
    """The listed sources; the table has one row per source and does not grow."""
    return sorted((r.s, r.target_share, r.max_repeats) for r in table(spark, d, "mix_targets").select(name_of("source").alias("s"), "target_share", "max_repeats").collect())


def mix(spark: SparkSession, d: str, total: float | None = None, part: float | None = None) -> Mix:
    docs = table(spark, d, "documents").select("doc_id", "text", name_of("source").alias("source"))
    return Mix(docs, "doc_id", "text", "source", targets(spark, d), total=total, seed=8, part=part)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Which text is used for which source, and how often."""
    return mix(spark, d).uses.withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix(spark, d).report()


def p8_report_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same with as many tokens as all listed texts have: short sources give all they may, and the shares reached differ."""
    return mix(spark, d, part=1.0).report()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all texts over the cut limits."""
    return cut(table(spark, d, "documents"), "doc_id", "text", limits(spark, d, "cut_")).withColumnRenamed("key", "doc_id")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes, "p4_documents": p4_documents, "p4_links": p4_links, "p6_found": p6_found, "p6_terms": p6_terms, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_report": p8_report, "p8_report_whole": p8_report_whole, "p9_pieces": p9_pieces}

_TERMS = f"""m as (select {name_sql('term')} term, {file_sql('fileid')} f from mentions), c as (select * from m where term is not null and f is not null),
 t as (select term, count(*) n, count(distinct f) n_files, (select count(distinct f) from c) total from c group by 1),
 k as (select term, n, n_files, case when n_files <= 2 then 'rare' when n_files * 10 > total then 'common' end mark from t)"""
ORACLE = {
    "p6_found": f"with {_TERMS} select term, mark from k where mark is not null",
    "p6_terms": f"with {_TERMS} select term, n, n_files, mark from k",
}
def _alike(source: str, k: int, share: tuple[int, int]) -> str:
    """Sets of word runs by record id, the classes of equal sets, and the pairs of classes with at least ``share`` in common.

    Sets are compared as sorted lists of hashes; pairs are found through every run that two classes share.
    """
    run = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    a, b = share
    return f"""b as ({source}), w as (select id, regexp_extract_all(lower(x), '[a-z0-9_]+') w from b),
 s as (select distinct id, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: hash({run}))) g from w),
 l as (select id, list(g order by g) gs, count(*) n from s group by 1),
 c as (select gs, any_value(n) n, min(id) least, count(*) size from l group by 1), e as (select least, n, unnest(gs) g from c),
 o as (select x.least a, y.least z, count(*) both_n from e x join e y on x.g = y.g and x.least < y.least group by 1, 2),
 p as (select a, z, both_n / (u.n + v.n - both_n) similarity from o join c u on u.least = a join c v on v.least = z where both_n * {b} >= {a} * (u.n + v.n - both_n))"""


_BLOCKS = _alike("select distinct block_key id, coalesce(sas_code, sas_text) x from blocks where block_key is not null", 3, (7, 10))
_DOCS = _alike("select distinct doc_id id, text x from documents where doc_id is not null", 5, (8, 10))
_CLASSES = """, k as (select least, count(*) n from (select a least from p union all select z from p) group by 1), ids as (select distinct id from b)
 select ids.id {id}, coalesce(c.least, ids.id) {cls}, coalesce(c.size - 1, 0) n_copies, coalesce(k.n, 0) n_links from ids left join l on l.id = ids.id left join c on c.gs = l.gs left join k on k.least = c.least"""
ORACLE |= {
    "p4_found": f"""with {_BLOCKS}, m as (select l.id, c.least from l join c on c.gs = l.gs),
 r as (select x.id i, y.id j from p join m x on x.least = p.a join m y on y.least = p.z union all select x.id, y.id from m x join m y on x.least = y.least and x.id < y.id)
 select distinct least(i, j) block_key_a, greatest(i, j) block_key_b from r where i <> j""",
    "p4_classes": f"with {_BLOCKS} {_CLASSES.format(id='block_key', cls='class_block_key')}",
    "p4_documents": f"with {_DOCS} {_CLASSES.format(id='doc_id', cls='class_doc_id')}",
    "p4_links": f"with {_DOCS} select a class_doc_id_a, z class_doc_id_b, similarity from p",
}
