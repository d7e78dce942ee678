"""Services: steps that read, change or write rows, stacked into a communication object.

A communication object has a stack of services; reading runs them from the source up, writing from the top down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.lang import tree as t
from lodestone.lang.parser import parse
from lodestone.lang.render import render


class Service:
    """``read`` gets the rows of the service below (None for a source); ``write`` gives rows for the service below (None at the end)."""

    def read(self, session, rows: DataFrame | None, options: dict) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} does not read")

    def write(self, session, rows: DataFrame, options: dict) -> DataFrame | None:
        raise NotImplementedError(f"{type(self).__name__} does not write")


class FileService(Service):
    """Files in any format that Spark reads and writes, with ``file_schema`` if given; ``stream`` asks for a stream."""

    def read(self, session, rows, options):
        reader = session.spark.readStream if options.get("stream") else session.spark.read
        if options.get("file_schema"):
            reader = reader.schema(options["file_schema"])
        return reader.format(options.get("format", "parquet")).options(**options.get("options", {})).load(options["address"])

    def write(self, session, rows, options):
        rows.write.mode(options.get("mode", "append")).format(options.get("format", "parquet")).options(**options.get("options", {})).save(options["address"])


class SocketService(Service):
    """Lines from a TCP socket, as a stream (value)."""

    def read(self, session, rows, options):
        host, _, port = options["address"].rpartition(":")
        return session.spark.readStream.format("socket").option("host", host or "localhost").option("port", port).load()


class RateService(Service):
    """A stream of ticks (timestamp, value)."""

    def read(self, session, rows, options):
        return session.spark.readStream.format("rate").option("rowsPerSecond", options.get("rows_per_second", 1)).load()


class JsonService(Service):
    """Rows to JSON text in ``value``, and back by a schema."""

    def read(self, session, rows, options):
        return rows.select(F.from_json("value", options["schema"]).alias("j")).select("j.*")

    def write(self, session, rows, options):
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


class RegexService(Service):
    """Text in ``value`` to fields, one for each group; all matches give rows. Texts without a match give none."""

    def read(self, session, rows, options):
        pattern, names = options["pattern"], options.get("fields")
        n = re.compile(pattern).groups
        names = names or [f"g{i + 1}" for i in range(n)]
        groups = [F.regexp_extract_all("value", F.lit(pattern), F.lit(i + 1)).alias(c) for i, c in enumerate(names)]
        return rows.select(F.explode(F.arrays_zip(*groups)).alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in names])


class EncryptionService(Service):
    """AES with authentication on ``value``; the key is an option."""

    def read(self, session, rows, options):
        return rows.withColumn("value", F.aes_decrypt("value", F.lit(options["key"])).cast("string"))

    def write(self, session, rows, options):
        return rows.withColumn("value", F.aes_encrypt("value", F.lit(options["key"])))


class StatementService(Service):
    """Statements as text: ``read`` checks and normalises all texts in ``value``, in the executors; ``most`` limits them if given."""

    def read(self, session, rows, options):
        def normal(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in blocks:
                yield pd.DataFrame({"value": [render(s) for x in block["value"] for s in parse(x)]}, dtype=object)

        rows = rows.limit(options["most"]) if "most" in options else rows
        return rows.select("value").mapInPandas(normal, "value string")

    def write(self, session, rows, options):
        return rows


class ProtobufService(Service):
    """Rows to protobuf messages and back; needs Spark's protobuf package on the class path and a descriptor file."""

    def read(self, session, rows, options):
        from pyspark.sql.protobuf.functions import from_protobuf

        return rows.select(from_protobuf("value", options["message"], options["descriptor"]).alias("m")).select("m.*")

    def write(self, session, rows, options):
        from pyspark.sql.protobuf.functions import to_protobuf

        return rows.select(to_protobuf(F.struct(*rows.columns), options["message"], options["descriptor"]).alias("value"))


BUILT_IN: dict[str, Service] = {
    "io": FileService(), "file": FileService(), "sockets": SocketService(), "socket": SocketService(), "rate": RateService(), "json": JsonService(), "regex": RegexService(), "encryption": EncryptionService(), "pathsql": StatementService(), "protobuf": ProtobufService(),
}


def _constant(v: object) -> object:
    if isinstance(v, t.Lit):
        return v.value
    if isinstance(v, (t.Coll, t.ArrayOf)):
        return [_constant(x) for x in v.items]
    if isinstance(v, t.Struct):
        return {k: _constant(x) for k, x in v.fields}
    if isinstance(v, t.MapOf):
        return {_constant(k): _constant(x) for k, x in v.pairs}
    if isinstance(v, t.Name):
        return v.parts[-1]
    return v


def stack_of(session, name: str) -> tuple[list[Service], dict]:
    """The services of a communication object, from the source up, and their options."""
    for kind in ("COMMUNICATION", "PIPELINE", "LISTENER"):
        if (c := session.catalog.others.get(kind, {}).get(name.lower())) is not None:
            break
    else:
        raise LookupError(f"no communication object {name}")
    body = c.body
    options = {k.lower(): _constant(v) for k, v in body.fields} if isinstance(body, t.Struct) else {}
    options |= {k.lower(): _constant(v) for k, v in c.props}
    if "on" in c.extra:
        options.setdefault("address", _constant(c.extra["on"]))
    names = options.get("service", options.get("listen")) if isinstance(body, t.Struct) else _constant(body)
    names = names if isinstance(names, list) else [names]
    out = []
    for n in names:
        s = session.services.get(str(n).lower()) or BUILT_IN.get(str(n).lower())
        if s is None:
            raise LookupError(f"no service {n}")
        out.append(s)
    return out, options


def read(session, name: str) -> DataFrame:
    services, options = stack_of(session, name)
    rows = None
    for s in services:
        rows = s.read(session, rows, options)
    return rows


def write(session, name: str, rows: DataFrame) -> None:
    services, options = stack_of(session, name)
    for s in reversed(services):
        rows = s.write(session, rows, options)
        if rows is None:
            return
