"""The structure of source text as relations over its tokens: brackets, segments, calls, functions, imports, by windows instead of a tree.

A token belongs to the innermost open bracket; its siblings are the tokens of the same bracket at the same depth, and a segment is a run of them: an
argument between commas, or a statement. What an expression holds, at any depth, is then a join of tokens with the brackets above theirs; that
closure doubles its reach each round. Only cutting text into tokens is Python, one file at a time.

For languages with braces. Defined results: a null content has no tokens; brackets that nothing closes end with the file; stray closers are skipped
over; a statement ends at a semicolon or where a line begins with a token that doesn't go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.operators.shared import cut
from quartzite.sources import code_source
from quartzite.sources.python_source import dealt

FILE = -1  # the bracket around everything
TOKEN = "path string, i int, kind string, text string, line int, fresh boolean"
#: Words that stand before a bracket without calling anything, words that aren't names, and tokens that go on over a line's end.
CONTROL = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "in", "of", "with", "super", "import", "case", "else", "do", "throw", "delete", "void", "yield", "async")
WORDS = CONTROL + ("const", "let", "var", "class", "extends", "implements", "interface", "enum", "export", "default", "from", "as", "true", "false", "null", "undefined", "this", "try", "finally", "break", "continue", "public", "private", "protected", "readonly", "static", "type", "instanceof")
GOES_ON = (".", "?.", "=", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "=>", "==", "===", "!=", "!==", "<=", ">=", "<", ">", "&", "|", "^", "+=", "-=", ",", "(", "[", "::", "->")
ASSIGNS = ("=", "+=", "-=", "*=", "/=", "??=", "||=", "&&=")


def _rows(path: str, language: str, content: str) -> list[tuple]:
    out, fresh = [], True
    for kind, text, line, _ in code_source.tokens(language, content) if language in code_source.LANGUAGES else []:
        if kind == "line":
            fresh = True
        elif kind != "comment":
            out.append((path, len(out), kind, text, line, fresh))
            fresh = False
            if kind == "string" and text[:1] == "`":  # what a template holds stands beside it
                for part in text.split("${")[1:]:
                    out += [(path, len(out) + k, *t[:2], line, False) for k, t in enumerate(x for x in code_source.tokens(language, part.split("}")[0]) if x[0] not in ("line", "comment") and x[1] not in ("{", "}"))]
    return out


def tokens(files: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """``path, i, kind, text, line, fresh``: the tokens of each file but comments and white space; fresh: first on its line."""
    names = [c.split()[0] for c in TOKEN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: list[tuple] = []
            for f in b.itertuples(index=False):
                held += _rows(f.path, f.language or "", f.content or "")
                if len(held) > 20_000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            yield pd.DataFrame(held, columns=names)

    return files.select(F.col(path).cast("string").alias("path"), F.col(language).alias("language"), F.col(content).alias("content")).transform(dealt).mapInPandas(run, TOKEN)


def is_name(text: Column, kind: Column) -> Column:
    return (kind == "word") & ~text.isin(*WORDS)


def placed(toks: DataFrame) -> DataFrame:
    """``toks`` with the texts around each (p1, p2, p3, n1), ``enc``, the innermost open bracket, ``of``, what a closer closes, and ``seg``, the
    number of its segment within ``enc``; ``stmt`` counts statements alone, over their commas."""
    order = Window.partitionBy("path").orderBy("i")
    opens, closes = F.col("text").isin("(", "[", "{"), F.col("text").isin(")", "]", "}")
    step = F.when((F.col("kind") == "op") & opens, 1).when((F.col("kind") == "op") & closes, -1).otherwise(0)
    t = toks.withColumn("step", step).withColumn("raw", F.sum("step").over(order))
    # a closer below all before it closes nothing
    low = F.least(F.lit(0), F.coalesce(F.min("raw").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("low", low).withColumn("depth", F.col("raw") - F.least("low", "raw")).withColumn("step", F.when(F.col("raw") < F.col("low"), 0).otherwise(F.col("step"))).drop("raw", "low")
    for name, shift in (("p1", -1), ("p2", -2), ("p3", -3), ("n1", 1), ("n2", 2), ("n3", 3)):
        t = t.withColumn(name, F.lead("text", shift).over(order) if shift > 0 else F.lag("text", -shift).over(order))
    t = t.withColumn("k1", F.lag("kind").over(order))
    # an opener also begins the level within, a closer also ends it
    roles = F.when(F.col("step") == 1, F.array(F.struct((F.col("depth") - 1).alias("level"), F.lit(0).alias("role")), F.struct(F.col("depth").alias("level"), F.lit(1).alias("role"))))
    roles = roles.when(F.col("step") == -1, F.array(F.struct(F.col("depth").alias("level"), F.lit(0).alias("role")), F.struct((F.col("depth") + 1).alias("level"), F.lit(2).alias("role"))))
    roles = F.explode(roles.otherwise(F.array(F.struct(F.col("depth").alias("level"), F.lit(0).alias("role"))))).alias("r")
    level = Window.partitionBy("path", "level").orderBy("i", F.desc("role"))
    r = t.select("*", roles).select("*", "r.level", "r.role").drop("r")
    r = r.withColumn("opened", F.last(F.when(F.col("role") == 1, F.col("i")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1)))
    whole = r.groupBy("path", "i").agg(
        *(F.any_value(c).alias(c) for c in ("kind", "text", "line", "fresh", "step", "p1", "p2", "p3", "n1", "n2", "n3", "k1")),
        F.coalesce(F.max(F.when(F.col("role") == 0, F.col("opened"))), F.lit(FILE)).alias("enc"), F.max(F.when(F.col("role") == 2, F.col("opened"))).alias("of"), F.max("level").alias("depth"),
    )
    braces = whole.where("step = 1").select("path", F.col("i").alias("enc"), F.col("text").alias("around"))
    whole = whole.join(braces, ["path", "enc"], "left").withColumn("around", F.coalesce("around", F.lit("{")))
    beside = Window.partitionBy("path", "enc").orderBy("i")
    before = F.lag("text").over(beside)
    ends = before.isin(";", ",") | (F.col("around") == "{") & F.col("fresh") & ~before.isin(*GOES_ON) & ~(F.col("text").isin(*GOES_ON) & ~F.col("text").isin("(", "[")) & ~F.col("text").isin("{", "}", ")", "]", ";")
    inner = before == ","
    begins = F.when(before.isNull(), 0).when(F.col("around") == "{", ends.cast("int")).otherwise(inner.cast("int"))
    whole = whole.withColumn("begins", F.coalesce(begins, F.lit(0))).withColumn("first", F.when(~inner, F.col("begins")).otherwise(0))
    return whole.withColumn("seg", F.sum("begins").over(beside)).withColumn("stmt", F.coalesce(F.sum("first").over(beside), F.lit(0))).drop("begins", "first")


def brackets(p: DataFrame) -> DataFrame:
    """``path, b, shape, close, enc, seg, p1, p2, p3, k1, line, depth, after, body``: after: the text behind the closer; body: the next brace of the same level."""
    closers = p.where("of is not null").select("path", F.col("of").alias("b"), F.col("i").alias("close"), F.col("n1").alias("after"), F.col("n2").alias("after2"), F.col("n3").alias("after3"))
    ahead = Window.partitionBy("path", "enc").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    own = p.withColumn("body", F.min(F.when((F.col("text") == "{") & (F.col("step") == 1), F.col("i"))).over(ahead)).where("step = 1")
    own = own.select("path", F.col("i").alias("b"), F.col("text").alias("shape"), "enc", "seg", "stmt", "p1", "p2", "p3", "k1", "line", "depth", "body")
    return own.join(closers, ["path", "b"], "left")


def chains(links: DataFrame) -> DataFrame:
    """``path, b, above, hops`` for every bracket and every one around it, itself included (hops 0). ``links``: path, b, enc. Reach doubles each round."""
    known = cut(links.where(F.col("enc") != FILE).select("path", "b", F.col("enc").alias("above"), F.lit(1).alias("hops")))
    reach = 1
    for _ in count():
        further = known.where(F.col("hops") == reach).join(known.select("path", F.col("b").alias("above"), F.col("above").alias("top"), F.col("hops").alias("more")), ["path", "above"])
        new = cut(further.select("path", "b", F.col("top").alias("above"), (F.col("hops") + F.col("more")).alias("hops")))
        if not new.limit(1).count():
            break
        known = cut(known.unionByName(new))
        reach *= 2
    own = links.select("path", "b", F.col("b").alias("above"), F.lit(0).alias("hops"))
    return known.unionByName(own).unionByName(links.select("path").distinct().select("path", F.lit(FILE).alias("b"), F.lit(FILE).alias("above"), F.lit(0).alias("hops")))


def functions(b: DataFrame) -> DataFrame:
    """``path, params, body, name, line``: functions with a body in braces: declared, assigned, or a name, parameters and a block."""
    name = F.when((F.col("p2") == "function") & ~F.col("p1").isin(*WORDS), F.col("p1"))
    arrow = (F.col("after") == "=>") & (F.col("after2") == "{")
    typed = (F.col("after") == ":") & (F.col("after3") == "{")
    assigned = F.when((F.col("p1") == "=") & arrow, F.col("p2")).when((F.col("p1") == "function") & (F.col("p2") == "="), F.col("p3"))
    bare = F.when((F.col("k1") == "word") & ~F.col("p1").isin(*WORDS) & ((F.col("after") == "{") | typed), F.col("p1"))
    any_ = F.coalesce(name, assigned, bare).isNotNull() | arrow | (F.col("p1") == "function")
    found = b.where((F.col("shape") == "(") & F.col("body").isNotNull() & any_)
    return found.select("path", F.col("b").alias("params"), "body", F.coalesce(name, assigned, bare).alias("name"), "line", "enc", "seg")


def calls(b: DataFrame, fns: DataFrame) -> DataFrame:
    """``path, b, callee, whole, line, enc, seg``: brackets after a name that define nothing; whole: with what it is a member of."""
    c = b.where((F.col("shape") == "(") & (F.col("k1") == "word") & ~F.col("p1").isin(*WORDS))
    c = c.join(fns.select("path", F.col("params").alias("b")), ["path", "b"], "left_anti")
    whole = F.when(F.col("p2").isin(".", "::", "?."), F.concat(F.col("p3"), F.col("p2"), F.col("p1"))).otherwise(F.col("p1"))
    return c.select("path", "b", F.col("p1").alias("callee"), whole.alias("whole"), "line", "enc", "seg")


def parameters(p: DataFrame, fns: DataFrame) -> DataFrame:
    """``path, body, pos, name``: plain parameters by their place."""
    first = p.where(is_name(F.col("text"), F.col("kind"))).groupBy("path", F.col("enc").alias("params"), "seg").agg(F.min_by("text", "i").alias("name"))
    return first.join(fns.select("path", "params", "body"), ["path", "params"]).select("path", "body", F.col("seg").cast("int").alias("pos"), "name")


def join_path(base: Column, relative: Column) -> Column:
    """A path relative to a file, without . and .. parts; above the top they vanish."""
    parts = F.split(F.concat_ws("/", F.regexp_extract(base, "^(.*)/[^/]*$", 1), relative), "/")
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(done, "/")


#: What is tried behind a specifier, in this order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def module_specifiers(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``path, specifier, target``: relative specifiers that name a file of ``files`` (path); of several endings that fit the first wins.
    ``asked``: path, specifier."""
    tried = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(ENDINGS)))).alias("t")
    a = asked.where(F.col("specifier").startswith(".")).distinct().select("path", "specifier", tried)
    a = a.select("path", "specifier", "t.k", F.concat(join_path(F.col("path"), F.col("specifier")), F.col("t.e")).alias("target"))
    hit = a.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("path", "specifier").agg(F.min_by("target", "k").alias("target"))


def import_bindings(p: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, local, target, exported`` of names imported from files at hand, and the ``path`` of every file with an import. A default import keeps its name."""
    starts = p.where("text = 'import' and kind = 'word' and enc = -1").select("path", "stmt")
    inside = p.join(starts.distinct(), ["path", "stmt"], "left_semi").where("enc = -1")
    spec = inside.where("kind = 'string'").groupBy("path", "stmt").agg(F.regexp_replace(F.min_by("text", "i"), "^[\"'`]|[\"'`]$", "").alias("specifier"))
    target = module_specifiers(spec, files)
    named = p.where("kind = 'word' and text not in ('as', 'type')").select("path", "enc", "seg", "i", "text").join(inside.where("text = '{'").select("path", F.col("i").alias("enc"), "stmt"), ["path", "enc"])
    named = named.groupBy("path", "stmt", "enc", "seg").agg(F.min_by("text", "i").alias("exported"), F.max_by("text", "i").alias("local")).select("path", "stmt", "local", "exported")
    plain = inside.where("kind = 'word' and p1 = 'import' and text not in ('type', 'from')").select("path", "stmt", F.col("text").alias("local"), F.col("text").alias("exported"))
    found = named.unionByName(plain).join(spec, ["path", "stmt"]).join(target, ["path", "specifier"])
    return found.select("path", "local", "target", "exported").distinct(), starts.select("path").distinct()
