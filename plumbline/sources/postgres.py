"""Vectors in a relational table with an index of its own, read over JDBC in sessions that cannot write.

A target is ``postgres://user:password@host:5432/db?table=schema.name&id=id&vector=embedding``. The driver class must be on
Spark's class path. Vectors travel as text, ``[v1,v2,...]``, which every version of the type gives.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.validate import UsageError
from plumbline.plans.redact import remember
from plumbline.session import default_tasks
from plumbline.sources import engines as E
from plumbline.sources.base import Capabilities, Descriptor, register

#: Queries whose searches make up one statement.
TOGETHER = 25


class PostgresSource:
    """``url`` replaces the address of the target, for another driver; ``text`` is how that driver gives a vector as text."""

    snapshot = False

    def __init__(self, spark: SparkSession, target: E.SqlTarget, url: str | None = None, text: str = "{}::text"):
        self.spark, self.target, self.text = spark, target, text
        self.url = url or E.jdbc_options(target)["url"]
        remember(target.password)
        self.warnings: list[str] = []
        self.meta = self._introspect()

    # --- statements on the driver: catalogue values, settings and plans, a few rows each ---

    def rows(self, sql: str) -> list[tuple]:
        """The rows of a statement as text, in a connection that is set to read only."""
        jvm = self.spark.sparkContext._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        properties = jvm.java.util.Properties()
        for key, value in (("user", self.target.user), ("password", self.target.password)):
            if value:
                properties.setProperty(key, value)
        try:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(jvm.java.sql.DriverManager.getDriver(self.url).getClass().getName())
            connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        except Exception as e:
            raise ConnectionError(f"no connection to {self.target.host}: {str(e).splitlines()[0][:200]}") from None
        finally:
            jvm.java.lang.Thread.currentThread().setContextClassLoader(loader)
        try:
            connection.setReadOnly(True)
            found = connection.createStatement().executeQuery(sql)
            n = found.getMetaData().getColumnCount()
            out = []
            while found.next():
                out.append(tuple(found.getString(i + 1) for i in range(n)))
            return out
        finally:
            connection.close()

    def _catalogue(self) -> dict:
        """Type of the column, access method and operator class of its index, the index's name and options."""
        t = self.target
        name = f"{E.quote_ident(t.schema)}.{E.quote_ident(t.table)}".replace("'", "''")
        column = t.vector_column.replace("'", "''")
        kind = self.rows(f"SELECT format_type(atttypid, atttypmod) FROM pg_attribute WHERE attrelid = '{name}'::regclass AND attname = '{column}' AND NOT attisdropped")
        if not kind:
            raise UsageError(f"no column {t.vector_column} in {t.schema}.{t.table}")
        index = self.rows(
            f"""SELECT m.amname, o.opcname, c.relname, array_to_string(c.reloptions, ',') FROM pg_index i JOIN pg_class c ON c.oid = i.indexrelid JOIN pg_am m ON m.oid = c.relam
JOIN pg_opclass o ON o.oid = i.indclass[0] JOIN pg_attribute a ON a.attrelid = i.indrelid AND a.attnum = i.indkey[0]
WHERE i.indrelid = '{name}'::regclass AND a.attname = '{column}' AND m.amname IN ({', '.join(f"'{m}'" for m in E.ACCESS_METHODS)}) ORDER BY c.relname LIMIT 1"""
        )
        method, opclass, relname, options = index[0] if index else (None, None, None, None)
        read_only = self.rows("SELECT current_setting('transaction_read_only')")[0][0]
        superuser = self.rows("SELECT rolsuper FROM pg_roles WHERE rolname = current_user")
        return {"type": kind[0][0], "method": method, "opclass": opclass, "index": relname, "options": (options or "").split(",") if options else [], "read_only": read_only == "on", "superuser": bool(superuser) and superuser[0][0] in ("t", "true")}

    def _introspect(self) -> dict:
        c = self._catalogue()
        if not c["read_only"]:
            raise UsageError("the session can write; it must be read only")
        if c["superuser"]:
            self.warnings.append("the session has the rights of a superuser; use a role that can only read")
        return {
            "kind": E.kind_of_access_method(c["method"]), "metric": E.metric_of_opclass(c["opclass"]) if c["opclass"] else "L2", "name": c["index"] or self.target.table,
            "dimension": E.dimension_of_type(c["type"]), "options": E.reloptions(c["options"]),
        }

    # --- the contract ---

    def descriptor(self) -> Descriptor:
        dimension = self.meta["dimension"]
        if dimension is None:
            first = self.corpus().select(F.size("vec").alias("d")).filter("d > 0").first()
            dimension = self.meta["dimension"] = first["d"] if first else 0
        t = self.target
        return Descriptor("postgres", self.meta["name"], self.meta["kind"], self.meta["metric"], dimension, f"postgres://{t.host}:{t.port}/{t.database}/{t.schema}.{t.table}")

    def capabilities(self) -> Capabilities:
        return Capabilities(deleted_counts=True, proxy_counts=True, search=True)

    def counts(self) -> dict:
        """Tuples as the statistics collector estimates them; the tuple statistics of the whole table if they can be read. Never exact."""
        t = self.target
        try:
            name = f"{t.schema}.{t.table}".replace("'", "''")
            found = self.rows(f"SELECT tuple_count, dead_tuple_count FROM pgstattuple('{name}')")
        except Exception:  # noqa: BLE001 - an extension that few have, or no right to it
            found = self.rows(E.counts_sql(t))
        live, dead = (int(x) if x is not None else None for x in found[0]) if found else (None, None)
        total = live + dead if live is not None and dead is not None else None
        return {"live": live, "deleted": dead, "total": total, "indexed": live, "exact": False}

    def _read(self, sql: str, **split) -> DataFrame:
        options = E.jdbc_options(self.target, **split) | {"url": self.url, "dbtable": f"({sql}) q"}
        if not self.url.startswith("jdbc:postgresql:"):
            options.pop("sessionInitStatement")
        return self.spark.read.format("jdbc").options(**options).load()

    def _table(self) -> str:
        return f"{E.quote_ident(self.target.schema)}.{E.quote_ident(self.target.table)}"

    def corpus(self) -> DataFrame:
        """Ids and vectors, split by ranges of the id; dead tuples cannot be seen."""
        t = self.target
        key = E.quote_ident(t.id_column)
        low, high = self.rows(f"SELECT min({key}), max({key}) FROM {self._table()}")[0]
        split = {"lower": int(low), "upper": int(high) + 1, "partitions": default_tasks(self.spark)} if low is not None and int(high) > int(low) else {}
        rows = self._read(f'SELECT {key} AS "id", {self.text.format(E.quote_ident(t.vector_column))} AS "vec" FROM {self._table()}', **split)
        return rows.select(F.col("id").cast("bigint").alias("id"), F.from_json("vec", "array<float>").alias("vec"), F.lit(False).alias("deleted"))

    def payload(self, field: str) -> DataFrame:
        rows = self._read(f'SELECT {E.quote_ident(self.target.id_column)} AS "id", {E.quote_ident(field)} AS "value" FROM {self._table()}')
        return rows.select(F.col("id").cast("bigint").alias("id"), F.col("value").alias(field))

    def partitions(self) -> None:
        return None

    def search(self, queries: DataFrame, k: int, params: dict | None = None) -> DataFrame:
        """``(qid, rank, id, dist)`` by the engine's own operator, a few statements for all queries; ``dist`` is the rank.

        The plan of the first search must use an index (if there is one): a sequential scan would measure nothing.
        """
        asked = queries.select("qid", "vec").orderBy("qid").toArrow()  # a stated query set, bounded by the audit
        if not asked.num_rows:
            return self.spark.createDataFrame([], "qid bigint, rank int, id bigint, dist double")
        pairs = list(zip(asked.column("qid").to_pylist(), asked.column("vec").to_pylist()))
        if self.meta["kind"] in ("IVF", "HNSW"):
            plan = self.rows("EXPLAIN (FORMAT JSON) " + self._nearest(pairs[0][1], k))[0][0]
            if not E.plan_uses_index(json.loads(plan)):
                raise UsageError("index_not_used: the plan of a search is a sequential scan")
        out = None
        for s in range(0, len(pairs), TOGETHER):
            one = " UNION ALL ".join(f"SELECT {int(q)} AS qid, r.* FROM (SELECT ROW_NUMBER() OVER () - 1 AS rank, s.* FROM ({self._nearest(v, k)}) s) r" for q, v in pairs[s : s + TOGETHER])
            part = self._read(one)
            out = part if out is None else out.unionByName(part)
        names = {c.lower(): c for c in out.columns}
        key = names[self.target.id_column.lower()]
        return out.select(F.col(names["qid"]).cast("bigint").alias("qid"), F.col(names["rank"]).cast("int").alias("rank"), F.col(key).cast("bigint").alias("id"), F.col(names["rank"]).cast("double").alias("dist"))

    def _nearest(self, vec: list[float], k: int) -> str:
        return E.search_sql(self.target, self.meta["metric"], k).replace("%s", f"'{E.vector_literal(vec)}'")


def open_postgres(spark: SparkSession, uri: str) -> PostgresSource:
    return PostgresSource(spark, E.parse_sql_target(uri))


register("postgres", open_postgres)
register("postgresql", open_postgres)
