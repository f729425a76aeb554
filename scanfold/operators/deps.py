"""Dependencies of package manifests: known malicious packages, names that imitate popular ones, install scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.session import small

SECTIONS = "dependencies devDependencies optionalDependencies peerDependencies".split()
HOOKS = "preinstall install postinstall prepare preuninstall postuninstall".split()
SUFFIXES = ["-js", "-node", "-npm", "-lib"]
# What an install script shouldn't do.
SCRIPT_PATTERNS = [r"curl\b.*\|\s*(?:ba)?sh\b", r"wget\b.*&&\s*(?:ba)?sh\b", r"\bnode\s+-e\b", r"\b(?:ba)?sh\s+-c\b", r"\|\s*base64\b", r">\s*/dev/null\s+2>&1", r"\$\([^)]+\)"]
MAX_DISTANCE = 2


def dependencies(manifests: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, section, name, version): the packages a manifest names. Text that is no JSON names none."""
    out = None
    for s in SECTIONS:
        m = F.from_json(F.get_json_object(text, f"$.{s}"), "map<string,string>")
        part = manifests.select(row_id, F.lit(s).alias("section"), F.explode_outer(m).alias("name", "version")).where(F.col("name").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def plain_version(version: F.Column) -> F.Column:
    return F.regexp_replace(F.trim(version), r"^[\^~]", "")


def malicious(deps: DataFrame, known: DataFrame) -> DataFrame:
    """Dependencies on packages of ``known`` (name, versions, reason): the version must be listed unless none is."""
    k = small(known.select("name", "versions", "reason"))
    return deps.join(k, "name").where((F.coalesce(F.size("versions"), F.lit(0)) <= 0) | F.array_contains("versions", plain_version(F.col("version")))).drop("versions")


def typosquats(deps: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, imitates, technique): distinct names that are not popular but look like one that is.

    Names and popular names are compared by blocks: each name is reduced to forms that an imitation shares with its
    model (suffix cut, separators out, doubled letters single), and all deletions of up to two letters stand for the
    names within two edits. Both sides meet in an equi-join; the exact distance decides. No pair is formed that shares
    no form, so this doesn't grow with names x popular names.
    """
    names = deps.select("name").where(F.length("name") > 2).distinct().join(popular.select(F.col("name")).distinct(), "name", "left_anti")
    models = popular.select(F.col("name").alias("imitates")).where(F.length("imitates") > 2).distinct()
    flat = lambda c: F.regexp_replace(c, "[-_.]", "")
    single = lambda c: F.regexp_replace(c, r"(.)\1+", "$1")
    found = []
    for s in SUFFIXES:
        found.append((names.where(F.col("name").endswith(s)).withColumn("f", F.expr(f"substring(name, 1, length(name) - {len(s)})")), models.withColumn("f", F.col("imitates")), "suffix"))
    found.append((names.withColumn("f", flat(F.col("name"))), models.where(F.col("imitates").rlike("[-_.]")).withColumn("f", flat(F.col("imitates"))), "separator"))
    found.append((names.withColumn("f", single(F.col("name"))), models.withColumn("f", single(F.col("imitates"))), "doubled"))
    out = None
    for a, b, how in found:
        part = a.join(b, "f").select("name", "imitates", F.lit(how).alias("technique"))
        out = part if out is None else out.unionByName(part)
    a = names.withColumn("f", F.explode(_deletions("name")))
    b = models.withColumn("f", F.explode(_deletions("imitates")))
    near = a.join(b, "f").select("name", "imitates").distinct().where(F.levenshtein("name", "imitates", MAX_DISTANCE) >= 0)
    out = out.unionByName(near.where(F.length("imitates") > 4).select("name", "imitates", F.lit("distance").alias("technique")))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in (("suffix", 0), ("separator", 1), ("doubled", 2), ("distance", 3)) for x in kv]), F.col("technique"))
    return out.groupBy("name").agg(F.min_by(F.struct("imitates", "technique"), F.struct(order, "imitates")).alias("x")).select("name", "x.imitates", "x.technique")


def _deletions(name: str) -> F.Column:
    """The name and what is left of it without any one or two of its letters."""
    n = F.col(name)
    one = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(n), one(n), F.flatten(F.transform(one(n), one))))


def install_scripts(manifests: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, hook, script): lifecycle scripts that download, hide or run code."""
    out = None
    for h in HOOKS:
        part = manifests.select(row_id, F.lit(h).alias("hook"), F.get_json_object(text, f"$.scripts.{h}").alias("script")).where(F.col("script").rlike("|".join(SCRIPT_PATTERNS)))
        out = part if out is None else out.unionByName(part)
    return out
