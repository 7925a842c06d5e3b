"""Facts of source files to raw nodes and links: modules and names are resolved by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, sanitise, strip_ext
from ..functions.vocabulary import PYTHON_STDLIB
from ..plans.storage import materialize
from .graph import first_by

_JS = r"\.(m|c)?[jt]sx?$"
#: Endings that an import without one may stand for, in the order in which they are tried.
CANDIDATES = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def _suffixes(path):
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _id(*parts):
    return sanitise(F.concat_ws("_", *parts))


def suffix_index(files: DataFrame) -> DataFrame:
    """(corpus, suffix, stem): every ending, at a slash, of every path without extension."""
    return files.select("corpus", strip_ext("path").alias("stem")).select("corpus", "stem", F.explode(_suffixes("stem")).alias("suffix"))


def nearest(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(corpus, path, suffix, stem): for each wanted suffix the file that shares most leading folders with the
    importer; none where two share as many."""
    met = wanted.select("corpus", "path", "suffix").distinct().join(index, ["corpus", "suffix"])
    same = F.zip_with(F.split("stem", "/"), F.split("path", "/"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same))
    met = met.withColumn("shared", shared)
    by = met.groupBy("corpus", "path", "suffix").agg(F.max(F.struct("shared", "stem")).alias("best"), F.collect_list("shared").alias("all"))
    alone = F.size(F.filter("all", lambda x: x == F.col("best.shared"))) == 1
    return by.where(alone).select("corpus", "path", "suffix", "best.stem")


def resolve_python(facts: DataFrame, index: DataFrame) -> DataFrame:
    """(corpus, path, module, target, rel, package): imported modules that are files of the corpus; a module goes
    before a package of that name. Leading dots count folders up from the importer."""
    said = facts.where(F.col("fact").isin("import", "from")).select("corpus", "path", "module").distinct()
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    folder = F.split("path", "/")
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots, F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace("module", r"^\.+", ""), r"\."), lambda x: x != "")
    rel = F.array_join(F.when(dots > 0, F.concat(up, rest)).otherwise(rest), "/")
    said = said.withColumn("rel", rel)
    out = said
    for name, suffix in (("as_module", F.col("rel")), ("as_package", F.concat("rel", F.lit("/__init__")))):
        found = nearest(said.withColumn("suffix", suffix), index).withColumnRenamed("stem", name)
        out = out.withColumn("suffix", suffix).join(found, ["corpus", "path", "suffix"], "left").drop("suffix")
    stem = F.coalesce("as_module", "as_package")
    return out.where(stem.isNotNull()).select("corpus", "path", "module", sanitise(stem).alias("target"), "rel", F.col("as_module").isNull().alias("package"))


def resolve_javascript(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(corpus, path, module, target, internal): relative imports by the endings they may stand for, in order; others by
    an alias prefix or several segments, if exactly one file ends so. Relative ones without a file stay external."""
    said = facts.where(F.col("fact").isin("import_module", "import_type") & F.col("path").rlike(_JS)).select("corpus", "path", "module").distinct()
    relative = said.where(F.startswith("module", F.lit(".")))
    folder = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    steps = F.concat(folder, F.split("module", "/"))

    def walk(done, step):
        return F.when(step.isin("", "."), done).when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step)))

    relative = relative.withColumn("stem", F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))
    bare = F.regexp_replace("stem", r"\.(js|jsx|mjs|cjs)$", "")
    tries = F.concat(
        F.array(F.col("stem")), F.when(F.col("stem") != bare, F.array(*[F.concat(bare, F.lit(e)) for e in (".ts", ".tsx", ".mts", ".cts")])).otherwise(F.array().cast("array<string>")),
        F.array(*[F.concat("stem", F.lit(e)) for e in CANDIDATES[1:]]),
    )
    tried = relative.select("corpus", "path", "module", "stem", F.posexplode(tries).alias("rank", "file"))
    exact = tried.join(files.select("corpus", F.col("path").alias("file")), ["corpus", "file"]).groupBy("corpus", "path", "module").agg(F.min_by("file", "rank").alias("file"))
    any_end = files.groupBy("corpus", strip_ext("path").alias("stem")).agg(F.min("path").alias("other"))
    out = relative.join(exact, ["corpus", "path", "module"], "left").join(any_end, ["corpus", "stem"], "left")
    hit = F.coalesce("file", "other")
    near = out.select("corpus", "path", "module", sanitise(strip_ext(F.coalesce(hit, F.col("stem")))).alias("target"), hit.isNotNull().alias("internal"))
    alias = said.where(~F.startswith("module", F.lit(".")) & (F.col("module").rlike("^[@~#]/") | (~F.startswith("module", F.lit("@")) & F.contains("module", F.lit("/")))))
    alias = alias.withColumn("suffix", F.regexp_replace(F.regexp_replace("module", "^[@~#]/", ""), _JS, ""))
    stems = files.where(F.col("path").rlike(_JS)).select("corpus", strip_ext("path").alias("stem"))
    both = stems.select("corpus", "stem", F.explode(F.array_distinct(F.array("stem", F.regexp_replace("stem", "/index$", "")))).alias("form"))
    ends = both.select("corpus", "stem", F.explode(_suffixes("form")).alias("suffix")).distinct()
    one = ends.groupBy("corpus", "suffix").agg(F.min("stem").alias("stem"), F.count("*").alias("n")).where("n = 1")
    far = alias.join(one, ["corpus", "suffix"]).select("corpus", "path", "module", sanitise("stem").alias("target"), F.lit(True).alias("internal"))
    return near.unionByName(far)


def raw_nodes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Files, declarations, members and docstrings as nodes; the first of equal ids stays."""
    file_id = sanitise(strip_ext("path"))
    loc = F.concat(F.lit("L"), F.col("line").cast("string")).alias("loc")
    own = files.select("corpus", file_id.alias("id"), basename("path").alias("label"), F.lit("code").alias("kind"), "path", F.lit("L1").alias("loc"), F.lit(0).alias("line"))
    top = facts.where(F.col("fact").isin("function", "class", "type", "value"))
    label = F.when(F.col("fact") == "function", F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    top = top.select("corpus", _id(file_id, F.col("name")).alias("id"), label.alias("label"), F.lit("code").alias("kind"), "path", loc, "line")
    member = facts.where("fact in ('member', 'property')")
    called = F.concat(F.lit("."), F.col("name"), F.when(F.col("fact") == "member", "()").otherwise(""))
    member = member.select("corpus", _id(file_id, F.col("owner"), F.col("name")).alias("id"), called.alias("label"), F.lit("code").alias("kind"), "path", loc, "line")
    said = facts.where("fact = 'rationale'")
    said = said.select("corpus", _id(file_id, F.lit("rationale"), F.col("line").cast("string")).alias("id"), F.col("text").alias("label"), F.lit("rationale").alias("kind"), "path", loc, "line")
    every = own.unionByName(top).unionByName(member).unionByName(said)
    return first_by(every.withColumn("order", F.struct("path", "line", "label")), ["corpus", "id"], "order").drop("order", "line")


def raw_links(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Links of all files. Ones to a name of another file stay only if it is a node there (Python imports and calls),
    others point where they say, be it outside the corpus. The first of equal (s, t, rel) stays."""
    facts = materialize(facts.withColumns({"file": sanitise(strip_ext("path")), "scope": sanitise("path"), "python": F.col("path").endswith(".py")}), "facts")
    nodes = materialize(raw_nodes(files, facts).select("corpus", "id"), "fact-nodes")
    index = suffix_index(files)
    py, js = resolve_python(facts, index), resolve_javascript(facts, files)
    out = []

    def link(rows, s, t, rel, deferred=F.lit(False)):
        out.append(rows.select("corpus", s.alias("s"), t.alias("t"), (rel if not isinstance(rel, str) else F.lit(rel)).alias("rel"), F.lit("EXTRACTED").alias("conf"), "path", "line", deferred.alias("deferred")))

    c = F.col
    owner = F.when(c("owner") == "", c("file")).otherwise(_id(c("file"), F.replace("owner", F.lit("."), F.lit("_"))))
    top = facts.where(c("fact").isin("function", "class", "type", "value"))
    link(top, c("file"), _id(c("file"), c("name")), "contains")
    link(facts.where("fact in ('member', 'property')"), _id(c("file"), c("owner")), _id(c("file"), c("owner"), c("name")), "method")
    link(facts.where("fact = 'rationale'"), _id(c("file"), F.lit("rationale"), c("line").cast("string")), owner, "rationale_for")
    for rel in ("references", "calls"):
        link(facts.where("fact = 'decorator'"), owner, _id(c("scope"), c("name")), rel)

    local = top.select("corpus", "path", c("name").alias("name"), _id(c("file"), c("name")).alias("local")).distinct()
    stdlib = lambda m: F.substring_index(m, ".", 1).isin(PYTHON_STDLIB)
    # Python imports.
    plain = facts.where("fact = 'import'").join(py, ["corpus", "path", "module"], "left")
    link(plain, c("file"), F.coalesce("target", sanitise("module")), "imports")
    whole = facts.where("fact = 'from'").join(py, ["corpus", "path", "module"], "left")
    link(whole, c("file"), F.coalesce("target", sanitise("module")), F.when(F.coalesce("package", F.lit(False)), "imports").otherwise("imports_from"))
    symbols = facts.where("fact = 'symbol' and python").join(py, ["corpus", "path", "module"], "left")
    sub = nearest(symbols.where("target is not null").withColumn("suffix", F.concat("rel", F.lit("/"), "name")), index)
    symbols = symbols.withColumn("suffix", F.concat("rel", F.lit("/"), "name")).join(sub, ["corpus", "path", "suffix"], "left")
    symbols = materialize(symbols.select("corpus", "path", "file", "scope", "line", "name", "module", "target", sanitise("stem").alias("sub")), "symbols")
    link(symbols.where("sub is not null"), c("file"), c("sub"), "imports_from")
    link(symbols.where("sub is null and target is not null"), c("file"), _id(c("target"), c("name")), "imports", F.lit(True))
    known = symbols.groupBy("corpus", "path", "name").agg(F.max_by(F.struct("module", "target", "sub"), "line").alias("imp"))
    # Python bases, annotations, calls.
    named = facts.where("python and fact in ('base', 'annotation', 'call')").join(local, ["corpus", "path", "name"], "left").join(known, ["corpus", "path", "name"], "left")
    imported = c("imp").isNotNull()
    base = F.coalesce("local", F.when(imported & ~stdlib(c("imp.module")), _id(c("scope"), c("name"))).otherwise(sanitise("name")))
    link(named.where("fact = 'base'"), owner, base, "inherits")
    noted = named.where((c("fact") == "annotation") & (c("local").isNotNull() | imported | c("name").rlike("^[A-Z]")))
    link(noted, owner, F.coalesce("local", _id(c("scope"), c("name"))), "references")
    called = named.where((c("fact") == "call") & (c("local").isNotNull() | c("imp.target").isNotNull() | (imported & ~stdlib(c("imp.module")))))
    inside = F.when(c("imp.target").isNotNull(), _id(c("imp.target"), c("name"))).otherwise(_id(c("scope"), c("name")))
    link(called, owner, F.coalesce("local", inside), "calls", c("local").isNull() & c("imp.target").isNotNull())
    # Python calls on something: own methods, submodules, imported modules, then any method of the class of that name.
    methods = facts.where("fact = 'member' and python").select("corpus", "path", c("owner").alias("class"), "name", _id(c("file"), c("owner"), c("name")).alias("method")).distinct()
    attr = facts.where("fact = 'method_call'").withColumn("class", F.when(F.contains("owner", F.lit(".")), F.substring_index("owner", ".", 1)))
    attr = attr.join(methods, ["corpus", "path", "class", "name"], "left")
    subs = known.where("imp.sub is not null").select("corpus", "path", c("name").alias("alias"), c("imp.sub").alias("sub"))
    modules = facts.where("fact = 'import'").groupBy("corpus", "path", "alias").agg(F.max_by("module", "line").alias("dotted"))
    attr = attr.join(subs, ["corpus", "path", "alias"], "left").join(modules.withColumnRenamed("dotted", "dotted"), ["corpus", "path", "alias"], "left")
    own = c("alias").isin("self", "cls") & c("method").isNotNull()
    target = (
        F.when(own, c("method")).when(c("sub").isNotNull(), _id(c("sub"), c("name")))
        .when(c("dotted").isNotNull(), F.when(~stdlib(c("dotted")), _id(c("scope"), c("name")))).otherwise(c("method"))
    )
    attr = attr.withColumn("to", target).where("to is not null")
    link(attr, owner, c("to"), "calls", F.coalesce(~own & c("sub").isNotNull(), F.lit(False)))
    # JavaScript and TypeScript.
    mods = facts.where(c("fact").isin("import_module", "import_type")).join(js, ["corpus", "path", "module"], "left")
    ref = F.concat(F.lit("ref_"), sanitise("module"))
    link(mods, c("file"), F.coalesce("target", ref), F.when(c("fact") == "import_type", "imports_type").otherwise("imports_from"))
    names = facts.where(c("fact").isin("symbol", "symbol_type") & ~c("python")).join(js.where("internal"), ["corpus", "path", "module"])
    link(names, c("file"), _id(c("target"), c("name")), F.when(c("fact") == "symbol_type", "imports_type").otherwise("imports"))
    bound = names.where("fact = 'symbol'").groupBy("corpus", "path", "name").agg(F.max_by("target", "line").alias("from_module"))
    uses = facts.where("not python and fact in ('call', 'jsx', 'base')").join(local, ["corpus", "path", "name"], "left").join(bound, ["corpus", "path", "name"], "left")
    link(uses.where("fact = 'base'"), owner, F.coalesce("local", sanitise("name")), "inherits")
    run = uses.where(c("fact").isin("call", "jsx")).withColumn("sure", c("local").isNotNull() & (c("local") != owner))
    link(run.where("sure"), owner, c("local"), "calls")
    link(run.where("not sure and fact = 'call' and from_module is not null"), owner, _id(c("from_module"), c("name")), "calls", F.lit(True))

    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    every = every.where("s is not null and t is not null and s <> '' and t <> '' and s <> t")
    ends = nodes.select("corpus", c("id").alias("t"), F.lit(True).alias("there"))
    every = every.join(ends, ["corpus", "t"], "left").where(~c("deferred") | c("there")).drop("deferred", "there")
    return first_by(every.withColumn("order", F.struct("path", "line")), ["corpus", "s", "t", "rel"], "order").drop("order")
