"""Sources and sinks: JSON lines, artifacts, files by content, HTML pages, sitemaps."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import let

_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'>]+)["']"""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; broken lines are dropped, or an error where strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_artifacts(spark: SparkSession, root: str, schemas: dict[str, str], required: tuple[str, ...] = ("doc_catalog",)) -> dict[str, DataFrame]:
    """Each artifact of a folder; a missing optional one is an empty frame of its schema.

    Only a path that is not there counts as missing; any other failure is an error.
    """
    out = {}
    for name, schema in schemas.items():
        path = confined(root, f"{name}.jsonl")
        there = name in required or _exists(spark, path)
        out[name] = read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where Spark itself is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written to the shared folder and read back: worked out once, whoever reads them."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def confined(root: str, name: str) -> str:
    """A path below root; names that leave it are refused."""
    path = posixpath.normpath(posixpath.join(root, name))
    if posixpath.isabs(name) or not path.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{name} leaves the folder")
    return path


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def detect_kind(content: Column) -> Column:
    """Kind of a binary by its first 512 bytes; HTML by what stands first behind white space."""
    begin = lambda text: F.lower(F.substring(F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+", ""), 1, 256))
    zeros = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\u0000"), F.lit("")))

    def kind(head: Column, text: Column) -> Column:
        page = let(begin(text), lambda x: x.startswith("<!doc") | x.startswith("<html"))
        return (
            F.when(text.startswith("%PDF"), "pdf").when(F.hex(head).startswith("FFD8FF"), "jpeg").when(F.hex(head).startswith("89504E470D0A1A0A"), "png")
            .when(page, "html").when((F.length(text) > 0) & (zeros(text) <= F.length(text) * 0.01), "txt").otherwise("unknown")
        )

    return let(F.substring(content, 1, 512), lambda head: let(F.decode(head, "ISO-8859-1"), lambda text: kind(head, text)))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): anchors of each page without mail and script links."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("pos", "link"))
    low = F.lower(F.trim("link"))
    return links.filter(~low.startswith("mailto:") & ~low.startswith("javascript:") & (low != "") & ~low.startswith("#"))


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(html if isinstance(html, Column) else F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """All <loc> values of sitemap files."""
    return spark.read.text(path, wholetext=True).select(F.explode(locations("value")).alias("url"))


def locations(xml: str) -> Column:
    """The <loc> values of a sitemap's text, without white space around them; broken XML is an error."""
    return F.filter(F.transform(F.expr(f"xpath({xml}, '//*[local-name()=\"loc\"]/text()')"), lambda u: F.trim(u)), lambda u: u != "")


def unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    """Collected rows whose url and content are both new."""
    return found.join(known.select("url"), "url", "left_anti").join(known.select("sha256"), "sha256", "left_anti")
