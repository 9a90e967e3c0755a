"""Lexical scopes as relations: bindings, the nearest enclosing binding of every reference, free names and captures.

A scope is a bracket: a block, a function's body (which its parameters belong to), the parentheses around an arrow function without a block, or the file.
Scopes nest, so the innermost of those that bind a name is found as brackets are matched: over the scopes that open and close and the references
in between, in order, the running depth of a place tells which opened last and is still open. That is two windows a name, whatever the depth;
nothing walks a tree or lists the scopes around a place. A name is free in a function if its binding opens before the function's body.

For languages with braces (see ``token_structure``). Defined results: names that nothing binds have no scope; a name bound twice in a scope is bound
by its first site; type positions, keys of object literals and members are no references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzite.operators import token_structure as ts
from quartzite.operators.shared import cut

END = 2**31 - 1  # where brackets that nothing closes end


@dataclass(frozen=True)
class Structure:
    """Tokens with their places, brackets, and functions."""

    placed: DataFrame
    brackets: DataFrame
    functions: DataFrame


def structure(files: DataFrame) -> Structure:
    p = cut(ts.placed(ts.tokens(files)))
    b = cut(ts.brackets(p))
    return Structure(p, b, cut(ts.functions(b)))


def innermost(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, pos, more) with ``span``, where the innermost of the nested ``spans`` (keys, open, close) around it opens, or null. A point at a
    span's opening is within. Spans repeated count once."""
    spans = spans.select(*keys, "open", "close").distinct()
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("open").alias("pos"), F.lit(0).alias("role")), F.struct(F.col("close").alias("pos"), F.lit(2).alias("role")))).alias("e"))
    rest = [c for c in points.columns if c not in (*keys, "pos")]
    rows = points.select(*keys, "pos", F.lit(1).alias("role"), F.struct(F.lit(0).alias("point"), *rest).alias("more"))
    rows = rows.unionByName(ends.select(*keys, "e.pos", "e.role", F.lit(None).cast(rows.schema["more"].dataType).alias("more")))
    order = Window.partitionBy(*keys).orderBy("pos", "role")
    rows = rows.withColumn("depth", F.sum(1 - F.col("role")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy(*keys, "depth").orderBy("pos", "role")
    rows = rows.withColumn("span", F.last(F.when(F.col("role") == 0, F.col("pos")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("role = 1").select(*keys, "pos", *(F.col(f"more.{c}").alias(c) for c in rest), F.when(F.col("depth") > 0, F.col("span")).alias("span"))


def _spans(s: Structure) -> DataFrame:
    """``path, open, close`` of every bracket and of every file."""
    b = s.brackets.select("path", F.col("b").alias("open"), F.coalesce("close", F.lit(END)).alias("close"))
    return b.unionByName(s.placed.select("path").distinct().select("path", F.lit(ts.FILE).alias("open"), F.lit(END).alias("close")))


def scope_of_function(s: Structure) -> DataFrame:
    """``path, b, owner``: the nearest function body around each bracket, itself included, or the file."""
    bodies = s.functions.select("path", F.col("body").alias("open")).join(_spans(s), ["path", "open"])
    every = _spans(s).select("path", F.col("open").alias("pos"), F.col("open").alias("b"))
    return innermost(every, bodies, ["path"]).select("path", "b", F.coalesce("span", F.lit(ts.FILE)).alias("owner"))


def bindings(s: Structure) -> DataFrame:
    """``path, scope, name, i, line, how`` (parameter, const, let, var, function, class, import, catch)."""
    p = s.placed.withColumn("own", ts.is_name(F.col("text"), F.col("kind")))
    owner = scope_of_function(s)
    site = lambda df, scope, how: df.select("path", F.col(scope).alias("scope"), F.col("text").alias("name"), "i", "line", how.alias("how") if not isinstance(how, str) else F.lit(how).alias("how"))
    first = p.where("kind = 'word' and text <> 'export'").groupBy("path", "enc", "seg").agg(F.min_by(F.struct("i", "text", "n1"), "i").alias("f"))
    declared = first.where(F.col("f.text").isin("const", "let", "var")).select("path", "enc", "seg", F.col("f.i").alias("at"), F.col("f.text").alias("how"))
    # a loop's head binds in its body; var climbs to the function
    heads = s.brackets.where("shape = '(' and p1 in ('for', 'catch') and body is not null").select("path", F.col("b").alias("enc"), "body")
    declared = declared.join(heads, ["path", "enc"], "left").join(owner.select("path", F.col("b").alias("enc"), "owner"), ["path", "enc"])
    declared = declared.withColumn("scope", F.when(F.col("how") == "var", F.col("owner")).otherwise(F.coalesce("body", "enc"))).select("path", "enc", "seg", "at", "how", "scope")
    plain = p.where("own and p1 in ('const', 'let', 'var')").join(declared, ["path", "enc", "seg"]).where("i = at + 1")
    more = p.where("own and p1 = ',' and n1 in ('=', ':', ';', ',')").where("around = '{'").select("path", "enc", "seg", "i", "text", "line", (F.col("seg") - 1).alias("before"))
    more = more.join(declared.select("path", "enc", F.col("seg").alias("before"), "how", "scope"), ["path", "enc", "before"])  # let a = 1, b = 2
    out = site(plain, "scope", F.col("how")).unionByName(site(more, "scope", F.col("how")))

    # patterns: after a declaring word, or in the place of a parameter
    opened = s.brackets.where("shape in ('{', '[')")
    after = opened.where("p1 in ('const', 'let', 'var')").join(declared.select("path", "enc", "seg", "scope", "how"), ["path", "enc", "seg"]).select("path", F.col("b").alias("above"), "scope", "how")
    given = s.functions.select("path", F.col("params").alias("enc"), F.col("body").alias("scope"))
    caught = heads.join(s.brackets.where("p1 = 'catch'").select("path", F.col("b").alias("enc")), ["path", "enc"]).select("path", "enc", F.col("body").alias("scope"), F.lit("catch").alias("how"))
    arrows = s.brackets.where("shape = '(' and after = '=>' and after2 <> '{'").select("path", F.col("b").alias("enc"), F.col("enc").alias("scope"))
    heads_of = given.unionByName(arrows).withColumn("how", F.lit("parameter")).unionByName(caught)
    inside = opened.where("p1 in ('(', ',')").join(heads_of, ["path", "enc"]).select("path", F.col("b").alias("above"), "scope", "how")
    patterns = after.unionByName(inside).withColumnRenamed("above", "open").join(_spans(s), ["path", "open"])
    leaves = p.where("own and n1 <> ':' and p1 in ('{', '[', ',', ':', '...')").select("path", F.col("i").alias("pos"), "i", "text", "line")
    leaves = innermost(leaves, patterns, ["path"]).withColumnRenamed("span", "open").join(patterns, ["path", "open"])
    out = out.unionByName(site(leaves, "scope", F.col("how")))
    params = p.where("own and p1 in ('(', ',', '...', 'public', 'private', 'protected', 'readonly')").join(heads_of, ["path", "enc"])
    out = out.unionByName(site(params, "scope", F.col("how")))
    # x => ... without parentheses: of the block that follows, else of the bracket around it
    block = s.brackets.where("shape = '{' and p1 = '=>'").select("path", F.col("enc"), (F.col("b") - 2).alias("i"), F.col("b").alias("block"))
    single = p.where("own and n1 = '=>'").join(block, ["path", "enc", "i"], "left").withColumn("scope", F.coalesce("block", "enc"))
    out = out.unionByName(site(single, "scope", "parameter"))

    named = s.functions.join(s.brackets.where("p2 = 'function'").select("path", F.col("b").alias("params")), ["path", "params"]).where("name is not null")
    where = named.select("path", F.col("enc").alias("scope"), "name", F.col("params").alias("i"), "line", F.lit("function").alias("how"))
    classes = site(p.where("own and p1 in ('class', 'enum')"), "enc", "class")
    bound = p.where("own and text not in ('as', 'type', 'from')").join(p.where("text = 'import' and enc = -1").select("path", F.col("stmt").alias("at")), "path")
    braces = s.brackets.where("shape = '{' and enc = -1").select("path", F.col("b").alias("enc"), F.col("stmt").alias("at"))
    local = bound.join(braces, ["path", "enc", "at"]).where("n1 <> 'as'")
    default = bound.where("enc = -1 and stmt = at and (p1 in ('import', 'as') or p1 = 'type')")
    bound = local.select("path", "text", "i", "line").unionByName(default.select("path", "text", "i", "line")).withColumn("scope", F.lit(ts.FILE))
    imports = site(bound, "scope", "import")
    return out.unionByName(where).unionByName(classes).unionByName(imports).distinct()


def references(s: Structure, bound: DataFrame) -> DataFrame:
    """``path, i, line, name, b``: names that are read or written, with the bracket they stand in."""
    p = s.placed.where(ts.is_name(F.col("text"), F.col("kind"))).where("not coalesce(p1 in ('.', '?.', 'function', 'class'), false)")
    typed = "p1 = ':' and (around = '(' or p3 in ('const', 'let', 'var'))"
    key = "n1 = ':' and around = '{' and p1 in ('{', ',')"
    p = p.where(f"not coalesce({typed}, false) and not coalesce({key}, false)")
    sites = bound.where("how <> 'function'").select("path", "i").distinct()
    heads = s.functions.select("path", F.col("params").alias("i")).union(s.functions.select("path", (F.col("params") - 1).alias("i"))).distinct()
    p = p.join(sites, ["path", "i"], "left_anti").join(heads, ["path", "i"], "left_anti")
    # what stands in a function's head belongs to its body
    inner = s.functions.select("path", F.col("params").alias("enc"), F.col("body").alias("inner"))
    p = p.join(inner, ["path", "enc"], "left")
    return p.select("path", "i", "line", F.col("text").alias("name"), F.coalesce("inner", "enc").alias("b"), F.coalesce("inner", "i").alias("pos"))


def resolved(s: Structure, bound: DataFrame | None = None) -> DataFrame:
    """References with ``scope``, ``bound_line`` and ``how`` of the innermost binding (null if there is none), ``owner``, the function they stand in, and
    ``captured``: the binding belongs to another function than the reference."""
    bound = cut(bindings(s)) if bound is None else bound
    sites = cut(bound.groupBy("path", "scope", "name").agg(F.min_by(F.struct("i", "line", "how"), "i").alias("site")))
    spans = sites.select("path", "name", F.col("scope").alias("open")).join(_spans(s), ["path", "open"])
    met = innermost(references(s, bound), spans, ["path", "name"]).withColumnRenamed("span", "scope")
    owner = cut(scope_of_function(s))
    out = met.join(sites, ["path", "scope", "name"], "left").select("path", "i", "line", "name", "b", "scope", F.col("site.line").alias("bound_line"), F.col("site.how").alias("how"))
    out = out.join(owner, ["path", "b"], "left").join(owner.select("path", F.col("b").alias("scope"), F.col("owner").alias("there")), ["path", "scope"], "left")
    return out.withColumn("captured", F.col("owner") != F.col("there")).drop("there")


def free_names(s: Structure, refs: DataFrame) -> DataFrame:
    """``path, body, name``: names that a function reads, at any depth, but binds nowhere within. ``refs``: from ``resolved``. A function's least
    binding of a name counts for it and for all functions around it that it opens before."""
    least = refs.where(F.col("owner") != ts.FILE).groupBy("path", "owner", "name").agg(F.min(F.coalesce("scope", F.lit(ts.FILE - 1))).alias("scope"))
    above = scope_of_function(s).join(s.brackets.select("path", F.col("b"), "enc"), ["path", "b"])
    outer = above.where("b = owner").select("path", "b", "enc").join(scope_of_function(s).select("path", F.col("b").alias("enc"), F.col("owner").alias("up")), ["path", "enc"])
    chain = ts.chains(outer.select("path", "b", F.col("up").alias("enc"))).select("path", F.col("b").alias("owner"), F.col("above").alias("body"))
    return least.join(chain, ["path", "owner"]).where("scope < body and body <> -1").select("path", "body", "name").distinct()


def own_bindings(s: Structure, bound: DataFrame) -> DataFrame:
    """``path, body, name``: what a function binds, not counting functions within it."""
    owner = scope_of_function(s).select("path", F.col("b").alias("scope"), F.col("owner").alias("body"))
    return bound.join(owner, ["path", "scope"]).where(F.col("body") != ts.FILE).select("path", "body", "name").distinct()
