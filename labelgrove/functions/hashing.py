"""Seeded, order-free randomness and fingerprints from content hashes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _parts(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_hex(*parts) -> Column:
    """SHA-256 hex of `a:b:c` (literals or columns)."""
    return F.sha2(_parts(*parts), 256)


def hash_int(*parts) -> Column:
    """First 32 bits of MD5 of `a:b:c` as a long."""
    return F.conv(F.substring(F.md5(_parts(*parts)), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Uniform number in [0, 1) fixed by its arguments."""
    return hash_int(*parts) / F.lit(4294967296.0)


def row_fingerprint(*cols: Column | str) -> Column:
    """60-bit fingerprint of one row; `bit_xor` over unique rows is an order-free table hash."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.conv(F.substring(F.md5(_parts(*parts)), 1, 15), 16, 10).cast("long")


def clip_id(*parts) -> Column:
    """First 16 hex digits of SHA-1 of `a:b:c`."""
    return F.substring(F.sha1(_parts(*parts)), 1, 16)


def file_sha256(spark: SparkSession, path: Column) -> Column:
    """SHA-256 hex of the file at `path`, in any store that Spark reads. The task that evaluates it reads
    the file as a stream, so neither its memory nor the length of an array bounds the file."""
    jvm = spark._jvm
    found = jvm.java.lang.Class.forName
    objects = jvm.org.apache.spark.sql.catalyst.expressions.objects
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils

    def kind(name: str):
        return jvm.org.apache.spark.sql.types.ObjectType(found(name))

    def seq(*x):
        return jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(x))

    def method(on, name: str, out: str, *args):
        return objects.Invoke(on, name, kind(out), seq(*args), seq(), True, True, False)

    def new(name: str, *args):
        return objects.NewInstance(found(name), seq(*args), seq(), False, kind(name), jvm.scala.Option.apply(None))

    def static(name: str, function: str, out, *args):
        return objects.StaticInvoke(found(name), out, function, seq(*args), seq(), True, True, False, jvm.scala.Option.apply(None))

    settings = "org.apache.spark.util.SerializableConfiguration"
    sent = jvm.org.apache.spark.sql.catalyst.expressions.Literal(
        jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf()), kind(settings))
    at = new("org.apache.hadoop.fs.Path", method(columns.expression(path._jc), "toString", "java.lang.String"))
    store = method(at, "getFileSystem", "org.apache.hadoop.fs.FileSystem", method(sent, "value", "org.apache.hadoop.conf.Configuration"))
    # closed at its end
    content = new("org.apache.commons.io.input.AutoCloseInputStream", method(store, "open", "org.apache.hadoop.fs.FSDataInputStream", at))
    digest = static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex", kind("java.lang.String"), content)
    text = jvm.org.apache.spark.sql.types.DataType.fromDDL("string")
    return Column(columns.column(static("org.apache.spark.unsafe.types.UTF8String", "fromString", text, digest)))


def crc_uniform(text: Column) -> Column:
    """CRC-32 of the text scaled to [0, 1)."""
    return F.crc32(text) / F.lit(4294967296.0)


def pick_split(u: Column, fractions: dict[str, float]) -> Column:
    """Split whose cumulative share contains `u`; the last split takes the rest."""
    total, acc, out = sum(fractions.values()), 0.0, None
    names = list(fractions)
    for name in names:
        acc += fractions[name] / total
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return out.otherwise(names[-1])
