"""Branches, tags, remotes and configuration as tables.

``refs``: ``canonical, oid, storage`` (loose or packed). ``config``: ``section, subsection, key, value, ordinal``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import objects as O


def effective(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per canonical name, the loose one where both exist."""
    both = loose.select("canonical", "oid", F.lit("loose").alias("storage"), F.lit(0).alias("_p")).unionByName(packed.select("canonical", "oid", F.lit("packed").alias("storage"), F.lit(1).alias("_p")))
    w = Window.partitionBy("canonical").orderBy("_p")
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_p")


def resolve_names(names: DataFrame, refs: DataFrame, prefixes: tuple[str, ...] = ("", "refs/heads/", "refs/remotes/")) -> DataFrame:
    """``name, canonical, oid``: a name as it is, then as a branch, then as a remote's branch; nulls where none fits."""
    out = names.select("name")
    for k, prefix in enumerate(prefixes):
        side = refs.select(F.col("canonical").alias(f"c{k}"), F.col("oid").alias(f"o{k}"))
        out = out.join(side, F.concat(F.lit(prefix), F.col("name")) == F.col(f"c{k}"), "left")
    return out.select("name", F.coalesce(*(f"c{k}" for k in range(len(prefixes)))).alias("canonical"), F.coalesce(*(f"o{k}" for k in range(len(prefixes)))).alias("oid"))


def parse_packed(lines: DataFrame) -> DataFrame:
    """``canonical, oid`` from the lines of a packed reference file; comments, peeled ids and other lines drop out."""
    found = r"^([0-9a-f]{40}) (refs/\S+)"
    return lines.filter(F.col("value").rlike(found)).select(F.regexp_extract("value", found, 2).alias("canonical"), F.regexp_extract("value", found, 1).alias("oid"))


def head_state(content):
    """``struct<kind,ref,oid>`` of a HEAD file: a branch by reference, or detached at a hash; other content is an error."""
    text = F.regexp_replace(content, r"[.\s]+$", "")
    ref = F.regexp_extract(text, r"^ref: (.+)$", 1)
    made = lambda kind, r, o: F.struct(F.lit(kind).alias("kind"), r.alias("ref"), o.alias("oid"))
    none = F.lit(None).cast("string")
    return F.when(ref != "", made("branch", ref, none)).when(O.is_hash(text), made("detached", F.lit("HEAD (detached)"), F.lower(text))).otherwise(F.raise_error(F.lit("Invalid HEAD.")))


def parse_config(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``section, subsection, key, value, ordinal`` from numbered lines (``ordinal, value``) of each configuration.

    Comments start with ; or #. Section and key names are lower-cased, subsections kept; a key without "=" is true.
    """
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    line = bare(F.col("value"))
    head = r'^\[\s*([A-Za-z0-9.-]+)\s*(?:"((?:[^"\\]|\\.)*)")?\s*\]'
    is_head = line.startswith("[")
    w = Window.partitionBy(*by).orderBy("ordinal")
    named = lines.filter((line != "") & ~line.rlike("^[;#]")).withColumn("_s", F.when(is_head, F.struct(F.lower(F.regexp_extract(line, head, 1)).alias("section"), F.regexp_extract(line, head, 2).alias("subsection"))))
    scoped = named.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter(~is_head & F.col("_s").isNotNull())
    parts = F.split(line, r"\s*=\s*", 2)
    return scoped.select(*by, F.col("_s.section").alias("section"), F.col("_s.subsection").alias("subsection"), F.lower(bare(parts[0])).alias("key"), F.when(F.size(parts) > 1, bare(parts[1])).otherwise(F.lit("true")).alias("value"), "ordinal")


def config_values(config: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One value per section, subsection and key: the last."""
    key = [*by, "section", "subsection", "key"]
    return config.groupBy(*key).agg(F.max_by("value", "ordinal").alias("value"))


#: Properties with a meaning of their own, and what they are when missing.
PROPERTIES = {"core.bare": "false", "core.ignorecase": "false", "core.autocrlf": "false", "core.commitgraph": "true", "core.repositoryformatversion": "0", "user.name": None, "user.email": None}


def properties(config: DataFrame) -> DataFrame:
    """``property, value`` of the known properties, defaults filled in."""
    spark = config.sparkSession
    known = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("property"), F.lit(v).cast("string").alias("default")) for k, v in PROPERTIES.items()))).alias("p")).select("p.*")
    values = config_values(config).filter("subsection = ''").select(F.concat_ws(".", "section", "key").alias("property"), "value")
    return known.join(values, "property", "left").select("property", F.coalesce("value", "default").alias("value"))


def upstreams(branches: DataFrame, config: DataFrame) -> DataFrame:
    """``branches`` (``friendly``) with ``remote`` and ``upstream`` as configured; nulls where they aren't."""
    values = config_values(config).filter("section = 'branch'")
    of = lambda key, name: values.filter(F.col("key") == key).select(F.col("subsection").alias("friendly"), F.col("value").alias(name))
    return branches.join(of("remote", "remote"), "friendly", "left").join(of("merge", "upstream"), "friendly", "left")


def remotes(config: DataFrame) -> DataFrame:
    """``name, url, fetch`` of every configured remote."""
    values = config_values(config).filter("section = 'remote'")
    return values.groupBy(F.col("subsection").alias("name")).pivot("key", ["url", "fetch"]).agg(F.first("value"))


def valid_name(canonical: str) -> bool:
    """Whether a reference may be called so."""
    parts = canonical.split("/")
    odd = any(ord(x) < 33 or x in "\x7f~^:?*[\\" for x in canonical) or ".." in canonical or "@{" in canonical
    return not odd and all(p and not p.startswith(".") and not p.endswith((".", ".lock")) for p in parts)


def packed_without(lines: DataFrame, canonical: str) -> DataFrame:
    """A packed reference file's numbered lines (``ordinal, value``) without one reference and its peeled id; all else stays."""
    w = Window.orderBy("ordinal")  # one small file
    gone = F.col("value").endswith(f" {canonical}")
    peeled = F.col("value").startswith("^") & F.coalesce(F.lag(gone).over(w), F.lit(False))
    return lines.withColumn("_gone", gone | peeled).filter(~F.col("_gone")).drop("_gone")


def remote_of(names: DataFrame, remotes: DataFrame) -> DataFrame:
    """``name, canonical, oid`` (the url) of remotes by plain or full name."""
    known = remotes.select(F.col("name").alias("canonical"), F.col("url").alias("oid"))
    plain = names.select("name", F.regexp_replace("name", "^(refs/)?remotes/", "").alias("_n"))
    found = resolve_names(plain.select(F.col("_n").alias("name")).distinct(), known, ("",))
    return plain.join(found.withColumnRenamed("name", "_n"), "_n").select("name", "canonical", "oid")


def moved(refs: DataFrame, canonical: str, oid: str | None, overwrite: bool = False) -> DataFrame:
    """``refs`` after creating, moving or (``oid`` None) deleting a reference; an existing one moves only with ``overwrite``."""
    rest = refs.filter(F.col("canonical") != canonical)
    if oid is None:
        return rest
    if not overwrite and refs.filter(F.col("canonical") == canonical).limit(1).count():
        raise ValueError(f"{canonical} exists already")
    new = refs.sparkSession.range(1).select(F.lit(canonical).alias("canonical"), F.lit(oid).alias("oid"), F.lit("loose").alias("storage"))
    return rest.select("canonical", "oid", "storage").unionByName(new)
