"""A catalog of immutable table versions.

A table is a list of parquet folders, which are never changed once written. A catalog state maps table names to such lists, schemas and
indices; it is committed as the next numbered manifest, in one step. Readers keep the state that they began with. Nothing is deleted but
by `vacuum`: folders that no manifest younger than a given age names, that are older than that themselves, and that no transaction open in
this process uses. So a transaction or a reader of another process is safe for that long.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError, EngineError, TransactionError
from ..types import LENGTH, kind_of, written
from .files import Files

#: Rows that INSERT sends to Spark at once; folders that it made, from which on they are written as one.
INSERT_ROWS, SMALL_FOLDERS = 10_000, 32


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.version, self.state = self._last()

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def _manifest(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.path}/manifests/{name}"))

    def _last(self) -> tuple[int, dict]:
        found = self._manifests()
        return (int(found[-1].split(".")[0]), self._manifest(found[-1])) if found else (0, {})

    def vacuum(self, older_than: float, pinned: Iterable[dict] = ()) -> list[str]:
        """Delete manifests but the last, and folders that are in no use, if they are older than so many seconds. `pinned` are states that
        open transactions use. The names of the folders that went."""
        manifests = self._manifests()
        old = [n for n in manifests[:-1] if self.files.age(f"{self.path}/manifests/{n}") > older_than]
        used = {p for state in [*map(self._manifest, (n for n in manifests if n not in old)), *pinned] for t in state.values() for p in t["folders"]}
        gone = [n for n in self.files.names(f"{self.path}/data") if n not in used and self.files.age(f"{self.path}/data/{n}") > older_than]
        for n in old:
            self.files.delete(f"{self.path}/manifests/{n}")
        for n in gone:
            self.files.delete(f"{self.path}/data/{n}")
        return gone

    def commit(self, state: dict, base: dict) -> None:
        """Make a state the current one. Tables that others changed since `base` must not be among those changed here."""
        changed = {t for t in {*state, *base} if state.get(t) != base.get(t)}
        while changed:
            self.version, now = self._last()
            if any(now.get(t) != base.get(t) for t in changed):
                raise TransactionError(f"changed by another transaction: {sorted(changed)}")
            lost = [p for t in changed & state.keys() for p in state[t]["folders"] if not self.files.exists(f"{self.path}/data/{p}")]
            if lost:
                raise TransactionError(f"folders of this transaction are gone: {lost}")
            merged = {**now, **{t: state[t] for t in changed if t in state}}
            for t in changed - state.keys():
                merged.pop(t, None)
            if self.files.create(f"{self.path}/manifests/{self.version + 1:012d}.json", json.dumps(merged)):
                self.version, self.state = self.version + 1, merged
                return

    def folder(self) -> str:
        return uuid.uuid4().hex


class Tables:
    """What a transaction sees and changes: a copy of a catalog state."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self.base = copy.deepcopy(catalog.state)
        self.state = copy.deepcopy(catalog.state)

    def key(self, name: str) -> str:
        return name.strip().lower()

    def entry(self, name: str) -> dict:
        if self.key(name) not in self.state:
            raise CatalogError(f"table {name} does not exist")
        return self.state[self.key(name)]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.entry(name)["schema"])

    def column(self, name: str, column: str) -> T.StructField:
        tail = column.split(".")[-1].lower()
        for f in self.schema(name):
            if f.name.lower() == tail:
                return f
        raise CatalogError(f"table {name} has no column {column}")

    def read(self, name: str, folders: list[str] | None = None) -> DataFrame:
        """A table's rows, or those of some of its folders."""
        schema = self.schema(name)
        folders = self.entry(name)["folders"] if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.catalog.path}/data/{p}" for p in folders])

    def create(self, name: str, schema: T.StructType) -> None:
        key = self.key(name)
        if not key or "." in key or " " in key:
            raise CatalogError(f"bad table name {name!r}")
        if key in self.state:
            raise CatalogError(f"table {name} exists")
        low = [f.name.lower() for f in schema]
        if len(set(low)) < len(low) or any("." in n for n in low):
            raise CatalogError("column names must differ, and hold no dot")
        self.state[key] = {"name": name.strip(), "schema": schema.jsonValue(), "folders": [], "indices": {}, "rows": 0}

    def drop(self, name: str) -> None:
        self.entry(name)
        del self.state[self.key(name)]

    def names(self) -> list[str]:
        return sorted(self.state)

    # writing

    def _store(self, df: DataFrame) -> str:
        folder = self.catalog.folder()
        df.write.parquet(f"{self.catalog.path}/data/{folder}")
        return folder

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows whose columns fit by position. Strings are cut to their column's length."""
        e, schema = self.entry(name), self.schema(name)
        if len(df.columns) != len(schema):
            raise EngineError(f"{len(schema)} columns are needed, {len(df.columns)} were given")
        named = df.toDF(*[f.name for f in schema])
        fitted = named.select(*[fit(F.col(f"`{f.name}`"), kind_of(g.dataType), f).alias(f.name) for f, g in zip(schema, df.schema, strict=True)])
        self._add(name, [self._store(fitted)])

    def _add(self, name: str, folders: list[str]) -> None:
        """New folders; their keys must be new ones."""
        e = self.entry(name)
        for column in e["indices"].values():
            self._check_new_keys(name, column, folders)
        e["folders"] = [*e["folders"], *folders]

    def insert(self, name: str, rows: list[list[object]]) -> int:
        schema, e = self.schema(name), self.entry(name)
        made = [self._store(self.spark.createDataFrame(part, schema).coalesce(1)) for part in batches([written(schema, r) for r in rows], INSERT_ROWS)]
        self._add(name, made)
        e["small"] = [p for p in e.get("small", []) if p in e["folders"]] + made
        if len(e["small"]) >= SMALL_FOLDERS:
            self.compact(name)
        return len(rows)

    def compact(self, name: str) -> None:
        """Write the folders that INSERT made as one."""
        e = self.entry(name)
        small = [p for p in e["folders"] if p in e.get("small", [])]
        if len(small) > 1:
            merged = self._store(self._clustered(name, self.read(name, small)) if e["indices"] else self.read(name, small).coalesce(1))
            e["folders"], e["small"] = [p for p in e["folders"] if p not in small] + [merged], []

    def rewrite(self, name: str, hit: Column, change: Callable[[DataFrame], DataFrame], changed: str | None = None) -> None:
        """Put new versions in the place of the folders that hold a row for which `hit` is true; the others stay as they are. `changed` is
        a column that gets new values."""
        e = self.entry(name)
        df = self.read(name)
        if not e["folders"]:
            return
        where = F.regexp_extract(df.metadataColumn("_metadata")["file_path"], r"/data/([0-9a-f]{32})/", 1)
        hits = {r[0] for r in df.where(hit).select(where).distinct().collect()}  # a table's folders at most
        if not hits:
            return
        new = self._store(self._clustered(name, change(self.read(name, [p for p in e["folders"] if p in hits]))))
        at = min(e["folders"].index(p) for p in hits)
        e["folders"] = [new if i == at else p for i, p in enumerate(e["folders"]) if i == at or p not in hits]
        if changed is not None and changed.lower() in e["indices"]:
            self._check_keys(name, e["indices"][changed.lower()])

    # indices

    def create_index(self, name: str, column: str) -> None:
        """A unique key: checked now and at every change. The table is rewritten in ranges of the key, sorted, so that scans for a range of
        it skip row groups by their minima and maxima."""
        f = self.column(name, column)
        e = self.entry(name)
        if f.name.lower() in e["indices"]:
            raise CatalogError(f"{name} has an index on {column}")
        self._check_keys(name, f.name)
        e["indices"][f.name.lower()] = f.name
        if e["folders"]:
            e["folders"] = [self._store(self._clustered(name, self.read(name)))]

    def drop_index(self, name: str, column: str) -> None:
        f = self.column(name, column)
        if f.name.lower() not in self.entry(name)["indices"]:
            raise CatalogError(f"{name} has no index on {column}")
        del self.entry(name)["indices"][f.name.lower()]

    def indices(self) -> list[tuple[str, str]]:
        return sorted((t, c) for t, e in self.state.items() for c in e["indices"].values())

    def _clustered(self, name: str, df: DataFrame) -> DataFrame:
        keys = list(self.entry(name)["indices"].values())
        return df.repartitionByRange(F.col(f"`{keys[0]}`")).sortWithinPartitions(F.col(f"`{keys[0]}`")) if keys else df

    def _check_keys(self, name: str, column: str) -> None:
        if not self.read(name).groupBy(F.col(f"`{column}`")).count().where("count > 1").isEmpty():
            raise EngineError(f"index on {name}({column}) has a repeated key")

    def _check_new_keys(self, name: str, column: str, folders: list[str]) -> None:
        """New rows' keys must differ, and be none of the table's, of which only those between the new ones' ends are read."""
        c = F.col(f"`{column}`")
        new = self.read(name, folders).groupBy(c.alias("_key")).count()
        n, low, high = new.agg(F.max("count"), F.min("_key"), F.max("_key")).first()
        there = self.read(name).where(c.between(F.lit(low), F.lit(high)) | c.isNull())
        if (n or 0) > 1 or not there.join(new, c.eqNullSafe(F.col("_key")), "left_semi").isEmpty():
            raise EngineError(f"index on {name}({column}) has a repeated key")


def fit(column, kind: str, f: T.StructField):
    """A column of one kind as what is written into a field."""
    want = kind_of(f.dataType)
    if kind == want or (kind, want) == ("int", "float"):
        out = column.cast(f.dataType)
        return F.substring(out, 1, f.metadata[LENGTH]) if want == "string" and LENGTH in f.metadata else out
    raise EngineError(f"{kind} does not fit {f.name} {want}")


def batches(rows: list, size: int) -> Iterator[list]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]
