"""Structural differences of two JSON documents, as columns.

Both documents become VARIANT once. A row holds the pairs of values that are still open, each with its path and its members;
a round replaces every pair of objects, and every pair of arrays, by the pairs of their members, and sets aside those that
differ as a whole. Writing a VARIANT's text is dear (each key and each string in it costs microseconds), so texts are
written of what is shown, of plain values other than strings, and of arrays right in arrays only. A round that has nothing
open does nothing, and there are as many as the text with fewer brackets has. All of it is expressions on the row's own
values, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ARRAY_KEYS = ["name", "containerPort", "port", "type", "key"]
NOISY = ["metadata.managedFields", "metadata.resourceVersion", "metadata.generation", "metadata.uid", "metadata.creationTimestamp", "status.observedGeneration"]
NOT_SPEC = ["status", "metadata.managedFields", "metadata.resourceVersion", "metadata.generation", "metadata.uid", "metadata.creationTimestamp"]
SECTIONS = ["status.conditions", "status.containerStatuses", "status.initContainerStatuses", "metadata.labels", "metadata.annotations"]
CONDITION_FIELDS = ["status", "reason", "message", "lastTransitionTime"]
#: Maps and arrays of more entries are shown with their size.
LARGE = 10

DIFF = "array<struct<path:string,op:string,old:string,new:string>>"
#: Values of which one is null if the other side alone has one.
MEMBER = "struct<path:string,old:variant,new:variant>"
#: Values whose members are to be compared, with those: of objects x and y, of arrays u and v.
OPEN = "struct<path:string,old:variant,new:variant,x:map<string,variant>,y:map<string,variant>,u:array<variant>,v:array<variant>,open:boolean>"
STATE = f"struct<open:array<{OPEN}>,done:array<{MEMBER}>>"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value stands once in the expression however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def document(text: Column) -> Column:
    """The text as a VARIANT; an empty object if it isn't a JSON object."""
    return _with(F.try_parse_json(text), lambda v: F.when(_object(v).isNotNull(), v).otherwise(F.parse_json(F.lit("{}"))))


def brackets(text: Column) -> Column:
    """How many brackets are opened in a text, those in strings too: objects and arrays don't lie deeper in each other. At least 1."""
    return F.greatest(F.length(text) - F.length(F.translate(text, "{[", "")), F.lit(1))


def same(old: Column, new: Column) -> Column:
    """Are two values equal? The order of keys doesn't matter, nor how a number is written."""
    kind, plain = F.schema_of_variant, lambda v: F.try_variant_get(v, "$", "string")
    number = lambda t: F.when(t.rlike(r"^-?[0-9]"), t.try_cast("double"))
    texts = lambda s: (s["a"] == s["b"]) | F.coalesce(number(s["a"]) == number(s["b"]), F.lit(False))
    return F.when((kind(old) == "STRING") & (kind(new) == "STRING"), plain(old) == plain(new)).otherwise(_with(F.struct(F.to_json(old).alias("a"), F.to_json(new).alias("b")), texts))


def _pairs(members: Column, in_array: Column) -> Column:
    """Members (path, old, new) that differ or whose own members may differ (open), with the latter. Arrays right in arrays are whole."""
    both = lambda m: m["old"].isNotNull() & m["new"].isNotNull()
    inside = lambda m: F.struct(*[m[c].alias(c) for c in ("path", "old", "new")], *[F.when(both(m), f(m[c])).alias(k) for k, f, c in (("x", _object, "old"), ("y", _object, "new"), ("u", _array, "old"), ("v", _array, "new"))])
    is_open = lambda m: (m["x"].isNotNull() & m["y"].isNotNull()) | (m["u"].isNotNull() & m["v"].isNotNull() & ~in_array)
    typed = F.transform(F.transform(members, inside), lambda m: F.struct(*[m[c].alias(c) for c in ("path", "old", "new", "x", "y", "u", "v")], is_open(m).alias("open")))
    one_has = lambda m, a, b: m[a].isNotNull() != m[b].isNotNull()
    return F.filter(typed, lambda m: m["open"] | ~both(m) | one_has(m, "x", "y") | one_has(m, "u", "v") | ~same(m["old"], m["new"]))


def _member(path: Column, old: Column, new: Column) -> Column:
    return F.struct(path.alias("path"), old.alias("old"), new.alias("new"))


def _keys(x: Column, y: Column) -> Column:
    """(field, x, y): the first key field that all elements of both arrays have, and its values in order; null if there is none."""
    has = lambda items, field: F.forall(items, lambda e: F.try_variant_get(e, f"$.{field}", "variant").isNotNull())
    names = lambda items, field: F.transform(items, lambda e: F.coalesce(F.try_variant_get(e, f"$.{field}", "string"), F.lit("<nil>")))
    out = None
    for field in ARRAY_KEYS:
        fits, keys = has(x, field) & has(y, field), F.struct(F.lit(field).alias("field"), names(x, field).alias("x"), names(y, field).alias("y"))
        out = F.when(fits, keys) if out is None else out.when(fits, keys)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), out)


def _members(p: Column) -> Column:
    """The pairs of an open pair's members: of objects by key, of arrays by the first key field that all elements have (of elements with the same key the last), else by index."""
    under = lambda k: F.when(p["path"] == "", k).otherwise(F.concat(p["path"], F.lit("."), k))
    at = lambda i: F.concat(p["path"], F.lit("["), i.cast("string"), F.lit("]"))

    def of_array(s: Column) -> Column:
        """s: both arrays in reverse order and their keys, so that the last of a key is met first."""
        field, x, y = s["keys"]["field"], s["keys"]["x"], s["keys"]["y"]
        label = lambda k: F.concat(p["path"], F.lit("["), field, F.lit("="), k, F.lit("]"))
        first = lambda items, keys, k: F.get(items, (F.array_position(keys, k) - 1).cast("int"))
        keyed = F.transform(F.array_union(x, y), lambda k: _member(label(k), first(s["u"], x, k), first(s["v"], y, k)))
        places = F.sequence(F.lit(0), F.greatest(F.size(s["u"]), F.size(s["v"])) - 1)
        placed = F.transform(places, lambda i: _member(at(i), F.get(s["u"], F.size(s["u"]) - 1 - i), F.get(s["v"], F.size(s["v"]) - 1 - i)))
        empty = (F.size(s["u"]) == 0) & (F.size(s["v"]) == 0)
        return F.when(empty, F.array().cast(f"array<{MEMBER}>")).when(s["keys"].isNotNull(), keyed).otherwise(placed)

    x, y = p["x"], p["y"]
    objects = F.transform(F.array_union(F.map_keys(x), F.map_keys(y)), lambda k: _member(under(k), F.try_element_at(x, k), F.try_element_at(y, k)))
    reversed_ = F.struct(F.reverse(p["u"]).alias("u"), F.reverse(p["v"]).alias("v"))
    arrays = _with(_with(reversed_, lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"), _keys(s["u"], s["v"]).alias("keys"))), of_array)
    return _pairs(F.when(x.isNotNull(), objects).otherwise(arrays), x.isNull())


def simplified(v: Column) -> Column:
    """A value as JSON text; maps and arrays of over ten entries with their size."""

    def text(t: Column) -> Column:
        large = lambda kind, what, n: F.concat(F.lit(f'{{"_type":"{kind}","{what}":'), n.cast("string"), F.lit(',"_value":'), t, F.lit("}"))
        keys, items = F.size(_object(v)), F.size(_array(v))
        long = F.length(t) > 2 * LARGE  # each entry has a character and a comma at least
        return F.when(~long, t).when(t.startswith("{") & (keys > LARGE), large("object", "_keys", keys)).when(t.startswith("[") & (items > LARGE), large("array", "_length", items)).otherwise(t)

    return F.when(v.isNotNull(), _with(F.to_json(v), text))


def json_diff(old: Column | str, new: Column | str) -> Column:
    """(path, op add/remove/replace, old, new) sorted by path. What isn't a JSON object counts as an empty one."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (old, new))

    def step(s: Column, _: Column) -> Column:
        found = F.flatten(F.transform(s["open"], _members))
        whole = lambda f: F.transform(F.filter(f, lambda p: ~p["open"]), lambda p: _member(p["path"], p["old"], p["new"]))
        dealt = _with(found, lambda f: F.struct(F.filter(f, lambda p: p["open"]).alias("open"), F.concat(s["done"], whole(f)).alias("done")))
        return F.when(F.size(s["open"]) > 0, dealt).otherwise(s)

    def shown(p: Column) -> Column:
        op = F.when(p["old"].isNull(), "add").when(p["new"].isNull(), "remove").otherwise("replace")
        return F.struct(p["path"].alias("path"), op.alias("op"), simplified(p["old"]).alias("old"), simplified(p["new"]).alias("new"))

    def compared(d: Column) -> Column:
        none = F.lit(None).cast("array<variant>")
        root = F.struct(F.lit("").alias("path"), d["v"].alias("old"), d["w"].alias("new"), _object(d["v"]).alias("x"), _object(d["w"]).alias("y"), none.alias("u"), none.alias("v"), F.lit(True).alias("open"))
        start = F.struct(F.array(root).alias("open"), F.array().alias("done")).cast(STATE)
        rounds = F.sequence(F.lit(1), F.coalesce(F.least(brackets(d["a"]), brackets(d["b"])), F.lit(1)))
        return F.array_sort(F.transform(F.aggregate(rounds, start, step, lambda s: s["done"]), shown)).cast(DIFF)

    texts = F.struct(a.alias("a"), b.alias("b"))
    documents = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), document(t["a"]).alias("v"), document(t["b"]).alias("w"))
    return _with(texts, lambda t: F.when(t["a"].eqNullSafe(t["b"]), F.array().cast(DIFF)).otherwise(_with(documents(t), compared)))


def event_diff(old: Column | str, new: Column | str, quiet: bool = True) -> Column:
    """(snapshot, diffs) of a single event: its own snapshot if there is none before, else the differences, without noise if quiet."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (old, new))
    diffs = json_diff(a, b)
    return F.struct(F.when(a.isNull(), b).alias("snapshot"), F.when(a.isNotNull(), without_noise(diffs) if quiet else diffs).alias("diffs"))


def _under(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= (path == p) | path.startswith(f"{p}.")
    return out


def without_noise(diffs: Column) -> Column:
    return F.filter(diffs, lambda d: ~_under(d["path"], NOISY))


def spec_only(diffs: Column) -> Column:
    return F.filter(diffs, lambda d: ~_under(d["path"], NOT_SPEC))


def status_only(diffs: Column) -> Column:
    return F.filter(diffs, lambda d: _under(d["path"], ["status"]))


def section(path: Column) -> Column:
    """The special section that a path lies in, else its first part."""
    out = F.substring_index(path, ".", 1)
    for s in SECTIONS:
        out = F.when((path == s) | path.startswith(f"{s}.") | path.startswith(f"{s}["), s).otherwise(out)
    return out


def shown_value(json: Column) -> Column:
    """A value in a unified diff: texts and objects cut to 100 characters, arrays as their length."""

    def made(j: Column) -> Column:
        return _with(F.struct(j.alias("j"), F.try_parse_json(j).alias("v")), lambda s: text(s["j"], s["v"]))

    def text(j: Column, v: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        quoted = F.concat(F.lit('"'), F.when(F.length(plain) > 100, F.concat(F.substring(plain, 1, 97), F.lit("..."))).otherwise(plain), F.lit('"'))
        cut = F.when(F.length(j) > 100, F.concat(F.substring(j, 1, 97), F.lit("..."))).otherwise(j)
        return F.when(j.isNull(), "null").when(j.startswith('"'), quoted).when(_array(v).isNotNull(), F.concat(F.lit("["), F.size(_array(v)).cast("string"), F.lit(" items]"))).otherwise(cut)

    return made(json)


def _condition_lines(d: Column) -> Column:
    """A status.conditions that was replaced as a whole, by type of condition."""
    parse = lambda t: _with(F.try_parse_json(t), lambda v: F.coalesce(_array(F.coalesce(F.try_variant_get(v, "$._value", "variant"), v)), F.array().cast("array<variant>")))
    kind = lambda c: F.try_variant_get(c, "$.type", "string")
    of = lambda s, k: _object(F.get(F.reverse(F.filter(s, lambda c: kind(c) == k)), F.lit(0)))
    none = F.array().cast("array<string>")

    def field(name: str, c: Column) -> Column:
        """The lines of a field of a condition (old, new)."""
        values = F.struct(*[F.to_json(F.try_element_at(c[x], F.lit(name))).alias(x) for x in ("old", "new")])
        line = lambda sign, v: F.when(v.isNotNull(), F.concat(F.lit(f"{sign}  {name}: "), shown_value(v)))
        return _with(values, lambda v: F.when(v["old"].eqNullSafe(v["new"]), none).otherwise(F.array_compact(F.array(line("-", v["old"]), line("+", v["new"])))))

    def block(k: Column, s: Column) -> Column:
        head = F.array(F.concat(F.lit("@@ status.conditions[type="), k, F.lit("] @@")))
        found = lambda c: F.concat(*[field(f, c) for f in CONDITION_FIELDS])
        shown = lambda c: _with(found(c), lambda x: F.when((F.size(x) > 0) | c["old"].isNull() | c["new"].isNull(), F.concat(head, x)).otherwise(none))
        return _with(F.struct(of(s["a"], k).alias("old"), of(s["b"], k).alias("new")), shown)

    types = lambda s: F.array_sort(F.array_compact(F.array_union(F.transform(s["a"], kind), F.transform(s["b"], kind))))
    return _with(F.struct(parse(d["old"]).alias("a"), parse(d["new"]).alias("b")), lambda s: F.flatten(F.transform(types(s), lambda k: block(k, s))))


def unified_diff(diffs: Column) -> Column:
    """Text with a section for each special part, or first part, of the paths; lines end with a line end."""

    def lines(s: Column, d: Column) -> Column:
        name = F.when(d["path"].startswith(F.concat(s, F.lit("."))), F.substring(d["path"], F.length(s) + 2, F.length(d["path"]))).otherwise(d["path"])
        minus = F.when(d["op"] != "add", F.concat(F.lit("-  "), name, F.lit(": "), shown_value(d["old"])))
        plus = F.when(d["op"] != "remove", F.concat(F.lit("+  "), name, F.lit(": "), shown_value(d["new"])))
        return F.array_compact(F.array(minus, plus))

    def block(s: Column, own: Column) -> Column:
        plain = F.concat(F.array(F.concat(F.lit("@@ "), s, F.lit(" @@"))), F.flatten(F.transform(own, lambda d: lines(s, d))))
        first = F.get(own, F.lit(0))
        replaced = (s == "status.conditions") & (F.size(own) == 1) & (first["op"] == "replace") & (first["path"] == s)
        return F.when(replaced, _condition_lines(first)).otherwise(plain)

    def text(every: Column) -> Column:
        sections = F.array_sort(F.array_distinct(F.transform(every, lambda d: section(d["path"]))))
        blocks = F.transform(sections, lambda s: _with(F.filter(every, lambda d: section(d["path"]) == s), lambda own: block(s, own)))
        return F.when(F.size(every) > 0, F.concat(F.array_join(F.flatten(blocks), "\n"), F.lit("\n"))).otherwise("")

    return _with(diffs, text)
