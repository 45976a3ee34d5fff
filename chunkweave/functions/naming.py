"""Names of paths, recipes and objects as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECIPE_BASE_BYTES = 96


def normalised(path: Column) -> Column:
    """Forward slashes, no leading or double ones, `.` and `x/..` resolved."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((x == "") | (x == "."), acc).when(x == "..", up).otherwise(F.array_append(acc, x))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def logical(prefix: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix.strip("/")), normalised(path)) if prefix.strip("/") else normalised(path)


def top_folder(path: Column) -> Column:
    """First folder; `(root)` for a file in none, `(unknown)` for no path."""
    parts = F.split(path, "/")
    return F.when(path.isNull() | (path == ""), "(unknown)").when(F.size(parts) == 1, "(root)").otherwise(parts[0])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def sanitised(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(clean == "", "file").otherwise(clean)


def recipe_name(path: Column) -> Column:
    """Sanitised base name, cut to 96 bytes, the path's SHA-1, `.recipe`."""
    return F.concat(F.substring(sanitised(base_name(path)), 1, RECIPE_BASE_BYTES), F.lit("-"), F.sha1(path), F.lit(".recipe"))


def legacy_name(path: Column) -> Column:
    return F.concat(F.translate(path, "/\\:", "--"), F.lit(".recipe"))


def resolved_recipes(requests: DataFrame, recipes: DataFrame) -> DataFrame:
    """requests(path) with `recipe`: the first of the literal, hashed and legacy names that recipes(name) has, else null."""
    names = recipes.select("name").distinct()
    tried = requests.select("path", F.posexplode(F.array(F.col("path"), recipe_name(F.col("path")), legacy_name(F.col("path")))).alias("at", "name"))
    found = tried.join(names, "name").groupBy("path").agg(F.min_by("name", "at").alias("recipe"))
    return requests.join(found, "path", "left")


def object_candidates(path: Column, recipe: Column) -> Column:
    """Names under which a whole file may be stored, in the order in which they are tried."""
    base = F.regexp_replace(base_name(recipe), r"\.recipe$", "")
    hashed = F.regexp_replace(recipe_name(path), r"\.recipe$", "")
    legacy = F.regexp_replace(legacy_name(path), r"\.recipe$", "")
    return F.array_distinct(F.array(legacy, hashed, base))


def valid_object(name: Column) -> Column:
    return (F.coalesce(name, F.lit("")) != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", "..")


def block_path(root: str, fp: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.substring(fp, 1, 2), F.lit("/"), fp)


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regex."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}$"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def size_label(n: Column) -> Column:
    """8192 -> 8KB, 1048576 -> 1MB, 100 -> 100B."""
    s = lambda x: x.cast("long").cast("string")
    mb = (n % (1 << 20) == 0) & (n > 0)
    return F.when(mb, F.concat(s(n / (1 << 20)), F.lit("MB"))).when((n % 1024 == 0) & (n > 0), F.concat(s(n / 1024), F.lit("KB"))).otherwise(F.concat(s(n), F.lit("B")))


def number_label(x: Column) -> Column:
    """0.5 -> 0p5."""
    return F.regexp_replace(x.cast("string"), r"\.", "p")


def scenario_label(kind: Column, ratio: Column) -> Column:
    return F.when(kind == "hybrid", F.concat(F.lit("hybrid-"), F.round(ratio * 100).cast("int").cast("string"), F.lit("%"))).otherwise(kind)
