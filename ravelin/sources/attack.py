"""A framework of techniques from its published STIX 2.1 bundles: tactics in the
order of the matrix, data components, techniques with their state, parent and
replacement, and which components detect them.

Objects refer to each other by their ids, which joins resolve; references to
objects that are not there are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Framework:
    #: (name, domain, version), one row.
    about: DataFrame
    #: (tactic, name, shortname, place)
    tactics: DataFrame
    #: (component, name)
    components: DataFrame
    #: (technique, name, tactics, platforms, state, replaced_by, parent)
    techniques: DataFrame
    #: (technique, component): the components whose analytics detect it.
    needs: DataFrame


def _text(path: str) -> Column:
    return F.try_variant_get("o", f"$.{path}", "string")


def _flag(path: str) -> Column:
    return F.coalesce(F.try_variant_get("o", f"$.{path}", "boolean"), F.lit(False))


def _list(path: str, kind: str = "string") -> Column:
    return F.coalesce(F.try_variant_get("o", f"$.{path}", f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _external() -> Column:
    """The id that the publisher itself gave an object."""
    refs = _list("external_references", "variant")
    own = F.filter(refs, lambda r: F.startswith(F.try_variant_get(r, "$.source_name", "string"), F.lit("mitre-")))
    return F.try_variant_get(F.get(own, F.lit(0)), "$.external_id", "string")


def framework(bundles: DataFrame, col: str = "bundle") -> Framework:
    """The framework of bundle texts, a row each."""
    read = F.from_json(F.col(col), "struct<type:string,objects:array<variant>>")
    o = bundles.select(read.alias("b")).filter("b.type = 'bundle'").select(F.explode("b.objects").alias("o")).select("o", _text("type").alias("type"), _text("id").alias("id"))
    of = lambda kind: o.filter(F.col("type") == kind)
    matrix = of("x-mitre-matrix").select(_external().alias("domain"), F.posexplode(_list("tactic_refs")).alias("place", "id"))
    named = of("x-mitre-tactic").select("id", _external().alias("tactic"), _text("name").alias("name"), _text("x_mitre_shortname").alias("shortname"))
    tactics = matrix.join(named.filter("tactic is not null and name is not null and shortname is not null"), "id").select("tactic", "name", "shortname", "place", "domain")
    about = of("x-mitre-collection").select(F.coalesce(_text("name"), F.lit("ATT&CK")).alias("name"), _text("x_mitre_version").alias("version")).join(matrix.select("domain").distinct(), F.lit(True), "left").select("name", "domain", "version")
    found = of("x-mitre-data-component").filter(~_flag("revoked") & ~_flag("x_mitre_deprecated")).select("id", _external().alias("component"), _text("name").alias("name")).filter("component is not null and name is not null")
    phases = F.transform(F.filter(_list("kill_chain_phases", "variant"), lambda p: F.try_variant_get(p, "$.kill_chain_name", "string") == "mitre-attack"), lambda p: F.try_variant_get(p, "$.phase_name", "string"))
    state = F.when(_flag("revoked"), "revoked").when(_flag("x_mitre_deprecated"), "deprecated").otherwise("active")
    patterns = of("attack-pattern").select("id", _external().alias("technique"), _text("name").alias("name"), phases.alias("phases"), _list("x_mitre_platforms").alias("platforms"), state.alias("state")).filter("technique is not null and name is not null")
    ordered = patterns.select("id", F.explode("phases").alias("shortname")).join(tactics.select("shortname", "place"), "shortname", "left")
    ordered = ordered.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(-1)).alias("place"), "shortname"))), lambda x: x["shortname"]).alias("tactics"))
    ties = of("relationship").select(_text("relationship_type").alias("kind"), _text("source_ref").alias("source"), _text("target_ref").alias("target"))
    ids = patterns.select("id", "technique")

    def related(kind: str, name: str) -> DataFrame:
        """What each technique's relation of a kind names, the last by its id."""
        both = ties.filter(F.col("kind") == kind).join(ids.select(F.col("id").alias("source")), "source").join(ids.select(F.col("id").alias("target"), "technique"), "target")
        return both.groupBy(F.col("source").alias("id")).agg(F.max("technique").alias(name))

    techniques = patterns.join(ordered, "id", "left").join(related("subtechnique-of", "parent"), "id", "left").join(related("revoked-by", "replaced_by"), "id", "left")
    techniques = techniques.withColumn("state", F.when(F.col("replaced_by").isNotNull(), "revoked").otherwise(F.col("state")))
    techniques = techniques.select("technique", "name", F.coalesce("tactics", F.array().cast("array<string>")).alias("tactics"), "platforms", "state", "replaced_by", "parent")
    strategies = of("x-mitre-detection-strategy").select(F.col("id").alias("source"), F.explode(_list("x_mitre_analytic_refs")).alias("analytic"))
    logs = of("x-mitre-analytic").select(F.col("id").alias("analytic"), F.explode(_list("x_mitre_log_source_references", "variant")).alias("l")).select("analytic", F.try_variant_get("l", "$.x_mitre_data_component_ref", "string").alias("cid"))
    detects = ties.filter("kind = 'detects'").join(ids.select(F.col("id").alias("target"), "technique"), "target")
    needs = detects.join(strategies, "source").join(logs, "analytic").join(found.select(F.col("id").alias("cid"), "component"), "cid").select("technique", "component").distinct()
    return Framework(about, tactics.drop("domain"), found.drop("id"), techniques, needs)


def broken_references(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(technique, state, replaced_by): techniques that ``rules`` name but that
    the framework has not, or no longer as active."""
    known = techniques.select("technique", "state", "replaced_by")
    return rules.select("technique").distinct().join(known, "technique", "left").filter("state is null or state <> 'active'").select("technique", F.coalesce("state", F.lit("unknown")).alias("state"), "replaced_by")
