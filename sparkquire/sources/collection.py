"""Collections on disk: a folder of tables each, a catalog of them, prompt templates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectorised import id_key


class Damaged(ValueError):
    """A table that an author owns can't be read: never taken for empty."""


@dataclass(frozen=True)
class Collection:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, spark: SparkSession, table: str, schema: str, owned: bool = False) -> DataFrame:
        """A JSON-lines table by its schema.  Missing is empty.  Lines that don't parse are dropped from
        tables that can be made again, and raise for ``owned`` ones."""
        if not Path(self.path(table).removeprefix("file:")).exists():
            return spark.createDataFrame([], schema)
        lines = spark.read.text(self.path(table)).where("trim(value) <> ''")
        rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
        if owned and not rows.where("_bad is not null").isEmpty():
            raise Damaged(self.path(table))
        return rows.where("_bad is null").drop("_bad")

    def write(self, rows: DataFrame, table: str) -> None:
        """By Spark's commit protocol: readers see the old table or the new one."""
        rows.write.mode("overwrite").json(self.path(table))

    def log(self, rows: DataFrame, table: str = "log") -> None:
        """Appends; a log that can't be written never fails the work."""
        try:
            rows.write.mode("append").json(self.path(table))
        except Exception:  # noqa: BLE001
            return


def _key(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]


def catalog(library: str) -> list[Collection]:
    """Collections in natural order: folders that hold a ``meta`` table."""
    found = [p.parent for p in Path(library).glob("*/meta")]
    return [Collection(str(p)) for p in sorted(found, key=lambda p: _key(p.name))]


def open_collection(library: str, name: str) -> Collection:
    """One collection by name; a name that leads out of the library is refused."""
    root = Path(library).resolve()
    path = (root / name).resolve()
    if root not in path.parents:
        raise ValueError(f"{name} lies outside the library")
    if not (path / "meta").exists():
        raise FileNotFoundError(name)
    return Collection(str(path))


def create(spark: SparkSession, library: str, title: str) -> Collection:
    """A new collection of a name made from the title; an existing one is left alone."""
    name = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", title).strip().strip(".").strip()
    if not name:
        raise ValueError("a title needs a letter")
    book = Collection(str(Path(library) / name))
    if Path(book.root).exists():
        raise FileExistsError(name)
    book.write(spark.createDataFrame([(1, title)], "schema int, title string"), "meta")
    return book


def template(text: str) -> tuple[Template, Template]:
    """The system and user parts of a prompt file: what stands under ``## system`` and ``## user``."""
    parts = re.split(r"(?m)^## (system|user)\s*$", text)
    found = dict(zip(parts[1::2], parts[2::2]))
    if set(found) != {"system", "user"}:
        raise ValueError("a prompt has a system and a user part")
    return Template(found["system"].strip()), Template(found["user"].strip())


def render(text: str, **values: str) -> tuple[str, str]:
    """Both parts with every $name replaced; one without a value raises."""
    system, user = template(text)
    return system.substitute(values), user.substitute(values)


def normalise_threads(raw: DataFrame) -> DataFrame:
    """Lines as authors may have left them: defaults for what is missing, times that aren't finite
    numbers dropped, unknown confidence as the lowest.
    raw: id, world, name, status, scenes array<string>, times map<string, struct<t:string, conf:string>>, offset string."""
    number = lambda s: s.try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    times = F.map_from_entries(F.filter(F.transform(F.map_entries(F.coalesce("times", F.create_map().cast("map<string,struct<t:string,conf:string>>"))), lambda e: F.struct(e["key"].alias("key"), F.struct(number(e["value"]["t"]).alias("t"), F.when(e["value"]["conf"].isin("高", "中", "低"), e["value"]["conf"]).otherwise("低").alias("conf")).alias("value"))), lambda e: e["value"]["t"].isNull() | finite(e["value"]["t"])))
    offset = number(F.col("offset"))
    return raw.where("id is not null and id <> ''").select("id", F.coalesce("world", F.lit("")).alias("world"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("status", F.lit("draft")).alias("status"), F.array_distinct(F.coalesce("scenes", F.array().cast("array<string>"))).alias("scenes"), times.alias("times"), F.when(finite(offset), offset).alias("offset"))


def same_id(a: str, b: str) -> bool:
    return id_key(a) == id_key(b)
