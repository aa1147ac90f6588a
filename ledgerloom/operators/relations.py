"""Matching, reconciling and comparing records: never a guess between several candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import _settled


def unique_lookup(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, right_id: str, prefix: str = "match") -> DataFrame:
    """left with {prefix}_id and {prefix}_state: resolved, ambiguous or unresolved, by how many right rows have the key."""
    counted = right.select(right_key.alias("_rk"), F.col(right_id).alias("_rid")).where("_rk is not null and _rk <> ''").groupBy("_rk").agg(F.count_distinct("_rid").alias("_n"), F.min("_rid").alias("_id"))
    j = left.withColumn("_lk", left_key).join(counted, F.col("_lk") == F.col("_rk"), "left")
    state = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return j.select(*left.columns, F.when(F.col("_n") == 1, F.col("_id")).alias(f"{prefix}_id"), state.alias(f"{prefix}_state"))


def cross_references(sections: DataFrame) -> DataFrame:
    """(source, reference, target, state) of every cross reference of every section.

    A reference is an id first, then a section number that exactly one section
    has; several make it ambiguous, none unresolved, itself circular.
    """
    refs = sections.select(F.col("id").alias("source"), F.explode("cross_references").alias("reference")).distinct()
    by_id = sections.select(F.col("id").alias("target_id"))
    r = refs.join(by_id, refs["reference"] == by_id["target_id"], "left")
    numbered = sections.where("level = 1")
    r = unique_lookup(r, numbered, T.section_number_key("reference"), T.section_number_key("section_number"), "id", "number")
    target = F.coalesce("target_id", "number_id")
    state = F.when(F.col("target_id").isNotNull(), "resolved").otherwise(F.col("number_state"))
    return r.select("source", "reference", target.alias("target"), F.when(target == F.col("source"), "self").otherwise(state).alias("state"))


def related_documents(docs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(a, b, shared): pairs of documents by the attributes (columns) they have in common, one row a pair and attribute."""
    parts = [docs.select("id", F.lit(c).alias("shared"), F.col(c).cast("string").alias("v")) for c in by]
    e = reduce(DataFrame.unionByName, parts).where("v is not null")
    x, y = e.alias("x"), e.alias("y")
    return x.join(y, ["shared", "v"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "shared")


def waterfall_match(old: DataFrame, new: DataFrame, rules: Sequence[tuple[str, Column]], id_col: str = "id") -> DataFrame:
    """(old_id, new_id, rule): rows matched by the first rule under which both have a key of their own.

    Every rule sees only rows that no earlier one took.  A key that several rows
    of a side share is ambiguous: its rows are taken, without a match, and fall
    through to no further rule.
    """
    names = [f"_k{i}" for i in range(len(rules))]
    keys = [F.when(key != "", key).alias(k) for k, (_, key) in zip(names, rules, strict=True)]
    o, n = (_settled(df.select(F.col(id_col).alias(name), *keys)) for df, name in ((old, "old_id"), (new, "new_id")))
    none_o, none_n = (F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((o, "old_id"), (n, "new_id")))
    out = []
    for k, (name, _) in zip(names, rules, strict=True):
        count = lambda df, c, m: df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(m), F.min(c).alias(c))  # noqa: B023, E731
        both = _settled(count(o, "old_id", "no").join(count(n, "new_id", "nn"), k))
        several = both.where("no > 1 or nn > 1").select(k)
        out += [both.where("no = 1 and nn = 1").select("old_id", "new_id", F.lit(name).alias("rule")),
                o.join(several, k).select("old_id", none_n, F.lit("ambiguous").alias("rule")), n.join(several, k).select(none_o, "new_id", F.lit("ambiguous").alias("rule"))]
        o, n = (_settled(df.join(both.select(k), k, "left_anti")) for df in (o, n))
    return reduce(DataFrame.unionByName, [*out, o.select("old_id", none_n, F.lit("removed").alias("rule")), n.select(none_o, "new_id", F.lit("added").alias("rule"))])


def revision_changes(old: DataFrame, new: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched sections with flags for content, structure and reference changes and the references added and removed."""
    pick = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "text", "path", "ord", "cross_references")))
    m = matched.where("old_id is not null and new_id is not null").join(pick(old, "o"), F.col("old_id") == F.col("o_id")).join(pick(new, "n"), F.col("new_id") == F.col("n_id"))
    added, removed = F.array_except("n_cross_references", "o_cross_references"), F.array_except("o_cross_references", "n_cross_references")
    content = ~T.squeezed("o_text").eqNullSafe(T.squeezed("n_text"))
    structure = (~F.col("o_path").eqNullSafe(F.col("n_path"))) | (~F.col("o_ord").eqNullSafe(F.col("n_ord")))
    refs = (F.size(added) > 0) | (F.size(removed) > 0)
    return m.select("old_id", "new_id", "rule", content.alias("content"), structure.alias("structure"), refs.alias("refs"), F.size(added).alias("refs_added"), F.size(removed).alias("refs_removed"),
                    F.when(content | structure | refs, "changed").otherwise("unchanged").alias("status"))


def revision_metrics(matched: DataFrame, changes: DataFrame) -> DataFrame:
    m = matched.agg(F.count_if(F.col("rule") == "added").alias("added"), F.count_if(F.col("rule") == "removed").alias("removed"), F.count_if(F.col("rule") == "ambiguous").alias("ambiguous"))
    c = changes.agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))
    return m.crossJoin(c)  # one row each


def reconcile(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status, changed_fields): new, changed, unchanged or possibly-removed. Nothing is ever deleted."""
    o = old.select(F.col(key).alias("_k"), F.lit(True).alias("_o"), *(F.col(f).alias(f"_o_{f}") for f in fields))
    n = new.select(F.col(key).alias("_j"), F.lit(True).alias("_n"), *(F.col(f).alias(f"_n_{f}") for f in fields))
    j = o.join(n, F.col("_k") == F.col("_j"), "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "possibly-removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    both = F.col("_o") & F.col("_n")
    return j.select(F.coalesce("_k", "_j").alias(key), status.alias("status"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of every key; of equal order an update wins."""
    u = base.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_u"))
    return u.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_u")


def effective_values(records: DataFrame) -> DataFrame:
    """normalized fields with overrides in their place: both maps of strings."""
    over = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    norm = F.coalesce("normalized", F.create_map().cast("map<string,string>"))
    return records.withColumn("effective", F.map_concat(F.map_filter(norm, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over))


def duplicates(docs: DataFrame, fingerprint: Column, id_col: str = "id") -> DataFrame:
    """(fingerprint, n, first, copies) of fingerprints that several documents have."""
    g = docs.select(fingerprint.alias("fingerprint"), F.col(id_col).alias("_i")).where("fingerprint is not null").groupBy("fingerprint")
    return g.agg(F.count("*").alias("n"), F.min("_i").alias("first"), F.max("_i").alias("last")).where("n > 1")


def lineage_families(docs: DataFrame) -> DataFrame:
    """Per lineage: versions, the newest revision and how many candidates claim to be it."""
    w = Window.partitionBy("lineage_id")
    d = docs.withColumn("_top", F.max("revision").over(w))
    return d.groupBy("lineage_id").agg(F.count("*").alias("versions"), F.max("revision").alias("newest"), F.count_if(F.col("revision") == F.col("_top")).alias("candidates"), F.max_by("id", F.struct("revision", "id")).alias("current"))


def catalog_diff(a: DataFrame, b: DataFrame, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(row, field, left, right) of fields that differ at the same position of two catalogs."""
    w = Window.orderBy(*order)  # positions of a catalog: a table of sheets, not of data
    number = lambda df, p: df.select(F.row_number().over(w).alias("row"), *(F.col(f).cast("string").alias(f"{p}_{f}") for f in fields))
    j = number(a, "a").join(number(b, "b"), "row", "full_outer")
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("left_value"), F.col(f"b_{f}").alias("right_value")) for f in fields)))
    return j.select("row", cells.alias("c")).select("row", "c.*").where("NOT left_value <=> right_value")


def union_by_priority(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several providers, one a key: the earliest provider's."""
    u = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(key).orderBy("_p")
    return u.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def page_ranges(starts: DataFrame, last_page: int, group: str = "document_id") -> DataFrame:
    """end_page: the page before the next start, the same page if that starts there, the last page at the end."""
    w = Window.partitionBy(group).orderBy("start_page", "id")
    nxt = F.lead("start_page").over(w)
    return starts.withColumn("end_page", F.when(nxt.isNull(), F.lit(last_page)).otherwise(F.greatest(F.col("start_page"), nxt - 1)))


def quality_report(sections: DataFrame) -> DataFrame:
    """One row a document: sections, empty texts, missing headings, duplicate ids, orphans, pages out of order."""
    ids = sections.select(F.col("id").alias("_pid"), F.lit(True).alias("_has")).distinct()
    per_id = Window.partitionBy("id")
    s = sections.withColumn("_same", F.count("*").over(per_id)).join(ids, F.col("parent_id") == F.col("_pid"), "left")
    return s.groupBy("document_id").agg(
        F.count("*").alias("sections"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_text"), F.count_if(F.coalesce(F.trim("heading"), F.lit("")) == "").alias("no_heading"),
        F.count_if(F.col("_same") > 1).alias("duplicate_ids"), F.count_if(F.col("parent_id").isNotNull() & F.col("_has").isNull()).alias("orphans"), F.count_if(F.col("page_start") > F.col("page_end")).alias("bad_pages"),
        F.count_if(F.col("page_start").isNull()).alias("no_pages"))
