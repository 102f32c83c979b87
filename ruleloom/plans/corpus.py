"""Rulemaking documents made by Spark from the tables orders and lineitem: one document an order, one provision a line.

The tables hold no mark-up, so queries write it from their columns; what the analysis must find in it follows from the
same columns, and the SQL beside each query states it in those terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.plans.analysis import Analysis
from ruleloom.session import drop_written, written
from ruleloom.sources import markup

KINDS = 10
#: A provision's text by the kind of its line: with [ ] for deletions and < > for additions.
BODIES = (
    "The customer [shall] <may> ship.",
    "A sum of [$10] <$15> applies.",
    "The [Customer] <customer> pays.",
    "Payment is due [in a] <in the> week.",
    "See [section 3.1] <section 3.2> here.",
    "It is [not] allowed to resell.",
    "The [rapid] <quick> process runs on.",
    "Terms <see> above.",
    "Reply within [ten] <twelve> business days.",
    "Flow of [20 MW] <30 MW> at most.",
)
AGENCY = "DEPARTMENT OF ENERGY Federal Energy Regulatory Commission"
LEGEND = "Deletions are in brackets and additions are in italics"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to four parts a core: a table of few bytes comes in few parts, whatever work its rows make."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def kind() -> Column:
    return ((F.col("l_partkey") + F.col("l_linenumber")) % KINDS).cast("int")


def body(k: Column, style: str) -> Column:
    """The provision's text as XML, or as it reads before or after."""
    import re

    def shown(b: str) -> str:
        if style == "xml":
            return re.sub("<([^>]*)>", r'<E T="03">\1</E>', b)
        gone, kept = (r"\1", "") if style == "before" else ("", r"\1")
        return re.sub("<([^>]*)>", kept, re.sub(r"\[([^\]]*)\]", gone, b))

    return F.element_at(F.array(*[F.lit(shown(b)) for b in BODIES]), k + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml. Orders of status P have no legend; those of priority 1-URGENT hold a decision about line 1's section."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    provision = F.concat(
        F.lit('<HD SOURCE="HD2">Section '), F.col("l_linenumber").cast("string"), F.lit(".1. Rates</HD><P>"), body(kind(), "xml"), F.lit("</P>")
    )
    own = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", provision.alias("p")))), lambda x: x["p"]), "").alias("provisions")
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    decided = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.concat(
            F.lit('<HD SOURCE="HD2">B. Compliance Procedures</HD><HD SOURCE="HD3">1. Commission Determination</HD><P>3. We modify section 1.1 as follows. '),
            F.lit("We require each provider to submit a compliance filing within "), (F.col("o_orderkey") % 18 + 1).cast("string"),
            F.lit(" months of the date of publication.</P>"),
        ),
    ).otherwise("")
    legend = F.when(F.col("o_orderstatus") == "P", "").otherwise(f"<NOTE><P>{LEGEND}</P></NOTE>")
    xml = F.concat(
        F.lit('<RULE><PREAMB><HD SOURCE="HED">Notice</HD></PREAMB><SUPLINF><HD SOURCE="HD1">I. Background</HD><P>1. Order '),
        F.col("o_orderkey").cast("string"),
        F.lit(' opens.<SU>7</SU></P><HD SOURCE="HD2">A. Issues</HD><P>2. We turn to them.</P>'),
        decided, F.lit('<HD SOURCE="HD1">Appendix A</HD>'), legend, F.coalesce("provisions", F.lit("")), F.lit("</SUPLINF></RULE>"),
    )
    return orders.join(own, "o_orderkey", "left").select(F.col("o_orderkey").alias("doc_id"), "day", xml.alias("xml"))


#: Analyses of this process, by what they were made from; their written stages are shared by all queries.
_KNOWN: dict[tuple, Analysis] = {}


def _version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> tuple:
    """Tells a table's present files from others at the same path, by all files' paths, sizes and times."""
    out = []
    for t in tables:
        files = read(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        out += files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return tuple(out)


def shared(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make) -> Analysis:
    """The analysis that make() gives, made once for a session and the tables' files."""
    key = (spark._jsparkSession.sessionUUID(), spark.conf.get("spark.checkpoint.dir", None), name, sf_dir, *_version(spark, sf_dir, tables))
    if key not in _KNOWN:
        _KNOWN[key] = make()
    return _KNOWN[key]


def drop_shared(spark: SparkSession) -> int:
    """Forgets this session's analyses and deletes all tables that it has written; gives their number."""
    own = spark._jsparkSession.sessionUUID()
    for key in [k for k in _KNOWN if k[0] == own]:
        del _KNOWN[key]
    return drop_written(spark)


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    def make() -> Analysis:
        docs = documents(spark, sf_dir)
        meta = docs.select(
            "doc_id", F.lit(AGENCY).alias("agency"), F.array(F.lit("Energy Department")).alias("agencies"), F.lit("final").alias("status"),
            F.col("day").alias("publication_date"), F.lit(None).cast("date").alias("effective_on"),
        )
        return Analysis(meta, written(markup.project(docs), "projected"), store=written)

    return shared(spark, sf_dir, "rulemaking", ("orders", "lineitem"), make)


def kind_sql(style: str) -> str:
    """DuckDB's CASE for body(): the reading of a line's provision."""
    import re

    out = []
    for i, b in enumerate(BODIES):
        gone, kept = (r"\1", "") if style == "before" else ("", r"\1")
        text = re.sub("<([^>]*)>", kept, re.sub(r"\[([^\]]*)\]", gone, b)).replace("'", "''")
        out.append(f"WHEN {i} THEN '{text}'")
    return f"CASE (l_partkey + l_linenumber) % {KINDS} {' '.join(out)} END"
