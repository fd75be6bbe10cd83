"""Dynamic JSON: parsing, paths, kinds and flattening, all on VARIANT values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden import constants as C
from callwarden.functions.base import col, let

#: What hangs below a container: names are NULL in an array.  A scalar has no such list.
KIDS_TYPE = "array<struct<key:string,value:variant>>"
NODE_TYPE = "struct<ord:array<int>,path:string,name:string,depth:int,leaf:boolean,value:variant>"
LEAF_TYPE = "struct<path:string,value:string>"
TEXT_TYPE = "struct<ord:array<int>,label:string,command:boolean,path_named:boolean,text:string>"


class JsonPathError(ValueError):
    """The path uses syntax outside the supported subset."""


def parse_json(text: Column | str) -> Column:
    """VARIANT, or NULL for text that is not JSON or repeats a key."""
    return F.try_parse_json(col(text))


def path_segments(path: str) -> list[str | int]:
    """`$.a.b`, `a.b`, `$.a[0]`, `$['q']` as names and indexes.

    Wildcards, recursive descent, slices, negative indexes, a bare `$` and an index on the
    root are refused: a predicate that can never match is a mistake worth reporting.
    """
    rest = path[1:] if path.startswith("$") else path
    token = re.compile(
        r"""\[(?:'(?P<sq>[^\]]+)'|"(?P<dq>[^\]]+)"|(?P<index>\d+))\]|(?P<dot>\.?)(?P<name>[^.\[*]+)"""
    )
    found: list[str | int] = []
    at = 0
    while at < len(rest):
        match = token.match(rest, at)
        bare = match is not None and match["name"] is not None and not match["dot"]
        if match is None or (bare and found):
            raise JsonPathError(f"unsupported argument path '{path}'")
        quoted = match["sq"] or match["dq"]
        found.append(int(match["index"]) if match["index"] else quoted or match["name"])
        at = match.end()
        if at < len(rest) and rest[at] not in ".[":
            raise JsonPathError(f"unsupported argument path '{path}'")
    if not found or isinstance(found[0], int):
        raise JsonPathError(f"unsupported argument path '{path}'")
    return found


def variant_path(path: str) -> str:
    """The same path in the form `variant_get` takes."""
    parts = ["$"]
    for segment in path_segments(path):
        if isinstance(segment, int):
            parts.append(f"[{segment}]")
        elif "'" not in segment:
            parts.append(f"['{segment}']")
        elif '"' not in segment:
            parts.append(f'["{segment}"]')
        else:
            raise JsonPathError(f"unsupported argument path '{path}'")
    return "".join(parts)


def json_path(arguments: Column | str, path: str) -> Column:
    """VARIANT at the path: SQL NULL when absent, a JSON null when present and null."""
    return F.try_variant_get(col(arguments), variant_path(path), "variant")


def json_kind(value: Column | str) -> Column:
    """string, number, boolean, null, array or object; SQL NULL when absent."""
    schema = F.schema_of_variant(col(value))
    return (
        F.when(schema == "STRING", F.lit("string"))
        .when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.lit("number"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema == "VOID", F.lit("null"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .when(schema.isNotNull(), F.lit("object"))
    )


def as_string(value: Column) -> Column:
    """The text of a string value, NULL for every other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _kids(value: Column) -> Column:
    """What hangs below a value, with names or without; NULL for a scalar."""
    items = F.try_variant_get(value, "$", "array<variant>")
    unnamed = F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), unnamed)


def nesting_bound(text: Column) -> Column:
    """An upper bound on the nesting of a JSON text: how often a container is opened."""
    return F.regexp_count(text, F.lit(r"[\[{]"))


#: Up to here the bound serves as it is: an empty level costs less than a look at the brackets.
_FEW = 4


def nesting(text: Column) -> Column:
    """How deep a JSON text is nested, at least 1; shallow texts may count too many levels, never too few.

    Brackets outside strings are taken in runs, so that siblings are no levels.
    """
    brackets = F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    runs = lambda i: F.regexp_extract_all(brackets, F.lit(r"([\[{]++)([\]}]*+)"), F.lit(i))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, run: Column) -> Column:
        top = acc["now"] + F.length(run["1"])
        return F.struct((top - F.length(run["2"])).alias("now"), F.greatest(acc["most"], top).alias("most"))

    exact = F.aggregate(F.arrays_zip(runs(1).alias("1"), runs(2).alias("2")), start, step, lambda acc: acc["most"])
    bound = nesting_bound(text)
    return F.coalesce(F.greatest(F.lit(1), F.when(bound <= _FEW, bound).otherwise(exact)), F.lit(1))


def _walk(root: Column, node_type: str, from_member, from_item, text: Column | None, nothing: Column, add, from_scalar=None) -> Column:
    """Breadth-first walk of one JSON value inside one row; what add(done, nodes) makes of its levels.

    One fold over the depth levels, to the last one, which the JSON text tells.  Nodes of the type hold `value`
    and its `kids`.  A fold copies its state in every step, so only the nodes of one level are in it, and of those
    before what is asked for; no rows are exploded, so nothing has to be shuffled back together.
    """
    empty = F.array().cast(f"array<{node_type}>")

    def below(parent: Column | None, kids: Column) -> Column:
        return F.transform(
            kids, lambda e, i: F.when(e["key"].isNull(), from_item(parent, e["value"], i)).otherwise(from_member(parent, e["key"], e["value"], i))
        )

    if from_scalar is not None:
        top = F.coalesce(below(None, _kids(root)), from_scalar(root), empty)
    else:  # objects only
        members = F.map_entries(F.try_variant_get(root, "$", "map<string,variant>"))
        top = F.coalesce(F.transform(members, lambda e, i: from_member(None, e["key"], e["value"], i)), empty)
    start = F.struct(top.cast(f"array<{node_type}>").alias("open"), nothing.alias("done"))

    def level(acc: Column, _: Column) -> Column:
        nested = F.struct(
            F.flatten(F.transform(acc["open"], lambda n: F.coalesce(below(n, n["kids"]), empty))).alias("open"),
            add(acc["done"], acc["open"]).alias("done"),
        )
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(nested)

    levels = nesting(F.to_json(root) if text is None else text)
    return F.aggregate(F.sequence(F.lit(1), levels), start, level, lambda acc: acc["done"])


def _json_walk(root: Column | str, text: Column | None, kept: str, keep) -> Column:
    """keep(node) of every nested value; see json_nodes."""
    node_type = f"struct<ord:array<int>,path:string,name:string,value:variant,kids:{KIDS_TYPE}>"

    def node(parent, path, name, value, i):
        order = F.array(i) if parent is None else F.concat(parent["ord"], F.array(i))
        return F.struct(order.alias("ord"), path.alias("path"), name.alias("name"), value.alias("value"), _kids(value).alias("kids"))

    def member(parent, key, value, i):
        step = F.when(
            key.rlike("^[A-Za-z_$][A-Za-z0-9_$-]*$"), F.concat(F.lit("."), key)
        ).otherwise(F.concat(F.lit("['"), F.regexp_replace(key, r"(['\\])", r"\\$1"), F.lit("']")))
        base = F.lit("$") if parent is None else parent["path"]
        return node(parent, F.concat(base, step), key, value, i)

    def item(parent, value, i):
        base = F.lit("$") if parent is None else parent["path"]
        path = F.concat(base, F.lit("["), i.cast("string"), F.lit("]"))
        return node(parent, path, F.lit(None).cast("string"), value, i)

    def scalar(value):
        return F.when(value.isNotNull(), F.array(node(None, F.lit("$"), F.lit(None).cast("string"), value, F.lit(0))))

    nothing = F.array().cast(f"array<{kept}>")
    return _walk(col(root), node_type, member, item, text, nothing, lambda done, nodes: F.concat(done, F.transform(nodes, keep)), scalar)


def json_nodes(root: Column | str, text: Column | None = None) -> Column:
    """Every nested value with its path and the property name it hangs under.

    Array items repeat no name.  A root that is no object is walked as well: an array's items come
    first, and a lone scalar is a node of its own at `$`.
    """

    def whole(n: Column) -> Column:
        return F.struct(
            n["ord"].alias("ord"), n["path"].alias("path"), n["name"].alias("name"), F.size(n["ord"]).alias("depth"),
            n["kids"].isNull().alias("leaf"), n["value"].alias("value"),
        )

    return _json_walk(root, text, NODE_TYPE, whole)


def json_strings(root: Column | str, text: Column | None = None) -> Column:
    """All strings of a value in document order, property names included."""

    def named(n: Column) -> Column:
        value = F.when(n["kids"].isNull(), as_string(n["value"]))
        return F.struct(n["ord"].alias("ord"), n["name"].alias("name"), value.alias("text"))

    nodes = F.array_sort(_json_walk(root, text, "struct<ord:array<int>,name:string,text:string>", named))
    return F.flatten(F.transform(nodes, lambda n: F.array_compact(F.array(n["name"], n["text"]))))


def normalised_leaf(value: Column) -> Column:
    """One text form per class of equal scalars: `1`, `1.0` and `1e0` are the same."""
    number = F.try_variant_get(value, "$", "double")
    whole = F.try_variant_get(value, "$", "bigint")
    text = F.try_variant_get(value, "$", "string")
    as_whole = F.concat(F.lit("n:"), F.coalesce(whole.cast("string"), number.cast("string")))
    as_number = F.concat(F.lit("n:"), F.when(number == whole.cast("double"), whole.cast("string")).otherwise(number.cast("string")))
    return let(
        F.schema_of_variant(value),
        lambda schema: F.when(schema == "STRING", F.concat(F.lit("s:"), text))
        .when(schema.rlike(r"^BIGINT|^DECIMAL\(\d+,0\)"), as_whole)
        .when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE)"), as_number)
        .when(schema == "BOOLEAN", F.concat(F.lit("b:"), text))
        .when(schema == "VOID", F.lit("z:"))
        .when(schema.startswith("ARRAY"), F.lit("a:"))
        .otherwise(F.lit("o:")),
    )


def json_leaves(root: Column | str, text: Column | None = None) -> Column:
    """Sorted array<struct<path, value>> of scalars and of the containers holding them.

    Containers are listed by kind only, so that empty ones are not lost.
    """

    def kind(n: Column) -> Column:
        """Of a container, without a look at what it holds."""
        is_object = F.when(F.size(n["kids"]) > 0, n["kids"][0]["key"].isNotNull()).otherwise(F.to_json(n["value"]) == "{}")
        return F.when(is_object, F.lit("o:")).otherwise(F.lit("a:"))

    def leaf(n: Column) -> Column:
        value = F.when(n["kids"].isNull(), normalised_leaf(n["value"])).otherwise(kind(n))
        return F.struct(n["path"].alias("path"), value.alias("value"))

    return F.array_sort(_json_walk(root, text, LEAF_TYPE, leaf))


# --- arguments ----------------------------------------------------------------


def _context(name: Column, words: list[str]) -> Column:
    """Is one of the words among the words of a name?  Names without any are not split."""
    from callwarden.functions.names import name_words

    padded = F.concat(F.lit(" "), F.array_join(name_words(name), " "), F.lit(" "))
    either = "|".join(words)
    return F.when(name.rlike(f"(?i){either}"), padded.rlike(f" (?:{either})s? ")).otherwise(F.lit(False))


def argument_strings(root: Column | str, text: Column, shell_tool: Column) -> Column:
    """struct<texts, values, chars, depth> of a call's arguments: strings with their reporting label, and sizes.

    In `texts`, `command` is inherited from the tool or any enclosing property, `path_named` is the nearest property's
    own.  `values` counts all values, `chars` the characters of names and strings.
    """
    node_type = f"struct<ord:array<int>,label:string,chars:bigint,command:boolean,path_named:boolean,value:variant,kids:{KIDS_TYPE}>"

    def node(order, label, chars, command, path_named, value):
        return F.struct(
            order.alias("ord"),
            label.alias("label"),
            chars.cast("bigint").alias("chars"),
            command.alias("command"),
            path_named.alias("path_named"),
            value.alias("value"),
            _kids(value).alias("kids"),
        )

    def member(parent, key, value, i):
        plain = key.rlike(r"\A[A-Za-z_][A-Za-z0-9_-]{0,%d}\z" % (C.MAX_PLAIN_NAME - 1))
        position = (i + F.lit(1)).cast("string")
        first = parent is None
        stand_in = F.concat(F.lit("argument #" if first else "property #"), position)
        name = F.when(plain, key).otherwise(stand_in)
        command = _context(key, C.COMMAND_WORDS)
        return node(
            F.array(i) if first else F.concat(parent["ord"], F.array(i)),
            name if first else F.concat(parent["label"], F.lit("."), name),
            F.length(key),
            command | (shell_tool if first else parent["command"]),
            _context(key, C.PATH_WORDS),
            value,
        )

    def item(parent, value, i):
        return node(
            F.concat(parent["ord"], F.array(i)),
            F.concat(parent["label"], F.lit("["), i.cast("string"), F.lit("]")),
            F.lit(0),
            parent["command"],
            parent["path_named"],
            value,
        )

    def string(n: Column) -> Column:
        return F.struct(
            n["ord"].alias("ord"), n["label"].alias("label"), n["command"].alias("command"), n["path_named"].alias("path_named"),
            as_string(n["value"]).alias("text"),
        )

    def add(done: Column, nodes: Column) -> Column:
        texts = F.filter(F.transform(F.filter(nodes, lambda n: n["kids"].isNull()), string), lambda n: n["text"].isNotNull())
        names = F.aggregate(nodes, done["chars"], lambda acc, n: acc + n["chars"])
        return let(
            texts,
            lambda found: F.struct(
                F.concat(done["texts"], found).alias("texts"),
                (done["values"] + F.size(nodes)).alias("values"),
                F.aggregate(found, names, lambda acc, n: acc + F.length(n["text"])).alias("chars"),
                (done["depth"] + F.lit(1)).alias("depth"),
            ),
        )

    none = F.lit(0)
    nothing = F.struct(F.array().cast(f"array<{TEXT_TYPE}>").alias("texts"), none.alias("values"), none.cast("bigint").alias("chars"), none.alias("depth"))
    return _walk(col(root), node_type, member, item, text, nothing, add)


def cut_label(label: Column) -> Column:
    return F.when(
        F.length(label) > C.MAX_LABEL, F.concat(F.substring(label, 1, C.MAX_LABEL), F.lit("\u2026"))
    ).otherwise(label)


# --- rewriting ----------------------------------------------------------------

#: Names of these characters alone are told apart by a pattern; others are looked at one by one.
_PLAIN = r"[A-Za-z0-9_ .\-]*"


def _pieces(words: list[str]) -> tuple[str, str]:
    """Patterns of the pieces of compact JSON, and of those that are runs.

    A run is closing brackets, a comma, then opening brackets and plain names that hold none of the words, each as far
    as there are any: what lies between two values, over any number of levels.  Other pieces are strings (with the
    colon after a name) and scalars.  Repeats are possessive, so that pieces of any length are matched in a loop.
    """
    name = rf'"(?!{_PLAIN}(?i:{"|".join(words)})){_PLAIN}+":'
    onward = rf"(?:[{{\[]|{name})"
    run = rf"[\]}}]++,?+{onward}*+|,{onward}*+|{onward}++"
    return rf'{run}|"[^"\\]*+(?:\\.[^"\\]*+)*+":?|[^\s"{{}}\[\],:]++', rf'\A(?:[\]}}\[{{,]|{name})'


#: Pieces that are put together at a time: texts are copied as often as pieces are added to them.
_BLOCK = 256


def quoted(text: Column) -> Column:
    """A string as it stands in compact JSON."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def unquoted(piece: Column) -> Column:
    """The string that a piece of compact JSON stands for."""
    plain = F.substring(piece, F.lit(2), F.length(piece) - 2)
    return F.when(~piece.contains("\\"), plain).otherwise(F.get_json_object(F.concat(F.lit('{"t":'), piece, F.lit("}")), "$.t"))


def rewrite_scalars(text: Column, words: list[str], is_marked, change) -> Column:
    """Compact JSON with every scalar value replaced by change(piece, marked).

    `marked` says whether the value hangs, at any depth, under a property whose name is_marked(name)
    picks; only names that hold one of the words, in any case, are picked, or names with other signs than plain ones.
    Names and structure stay.  A fold over the pieces of the text, in blocks whose results are joined
    once: what it takes grows with the length of the text, whatever is in it.
    """

    def state(out: Column, depth: Column, since: Column, named: Column) -> Column:
        return F.struct(out.alias("out"), depth.alias("depth"), since.alias("since"), named.alias("named"))

    # `since`: the depth of the outermost container under a marked name, 0 outside; `named`: the value
    # that comes next has a marked name of its own.
    none, no = F.lit(0), F.lit(False)
    pattern, is_run = _pieces(words)

    def run(acc: Column, piece: Column) -> Column:
        def after(closers: Column) -> Column:
            closed = acc["depth"] - closers
            left = F.when(acc["since"] > closed, none).otherwise(acc["since"])
            # an opening bracket comes first only behind a name, so nothing was closed
            under = acc["named"] & (acc["since"] == 0) & piece.rlike(r"\A[\[{]")
            opened = F.regexp_count(piece, F.lit(r"[\[{]"))
            return state(F.concat(acc["out"], piece), closed + opened, F.when(under, closed + 1).otherwise(left), no)

        return F.when(piece == ",", state(F.concat(acc["out"], piece), acc["depth"], acc["since"], no)).otherwise(
            let(F.length(F.regexp_extract(piece, r"\A[\]}]*+", 0)), after)
        )

    def step(acc: Column, piece: Column) -> Column:
        onward, depth, since = F.concat(acc["out"], piece), acc["depth"], acc["since"]
        is_name = piece.startswith('"') & piece.endswith('":')
        name = unquoted(F.substring(piece, F.lit(1), F.length(piece) - 1))
        return (
            F.when(piece.rlike(is_run), run(acc, piece))
            .when(is_name, state(onward, depth, since, (since == 0) & is_marked(name)))
            .otherwise(state(F.concat(acc["out"], change(piece, acc["named"] | (since > 0))), depth, since, no))
        )

    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blocks = lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")), lambda i: F.slice(all_, i * _BLOCK + 1, F.lit(_BLOCK))
    )
    begin = F.struct(F.array().cast("array<string>").alias("parts"), state(F.lit(""), none, none, no).alias("last"))

    def block(acc: Column, some: Column) -> Column:
        last = acc["last"]
        return F.struct(
            F.concat(acc["parts"], F.array(last["out"])).alias("parts"),
            F.aggregate(some, state(F.lit(""), last["depth"], last["since"], last["named"]), step).alias("last"),
        )

    whole = lambda acc: F.array_join(F.concat(acc["parts"], F.array(acc["last"]["out"])), "")
    # the pieces are taken apart once: a one-element array hands them to the fold
    return F.element_at(F.transform(F.array(pieces), lambda all_: F.when(F.size(all_) == 0, F.lit("")).otherwise(F.aggregate(blocks(all_), begin, block, whole))), 1)


# --- one text for equal values ------------------------------------------------

#: A number that may be spelled in several ways, or that a long does not hold, in compact JSON.
_SPELLED = r"[0-9][.eE]|[0-9]{19}"
#: In the place of words: no name holds it.
_NO_WORD = "(?!)"


def canonical_json(text: Column) -> Column:
    """One compact text for equal JSON, whatever its spacing, order of keys and spelling of numbers.

    Texts differ where `json_leaves` do; what is not JSON, and an empty root, is the empty text.  VARIANT sorts the
    keys, so no value is walked: only texts with such numbers, outside strings, are taken apart.
    """
    compact = F.to_json(F.try_parse_json(text))
    outside = F.regexp_replace(compact, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")

    def number(piece: Column, _: Column) -> Column:
        spelled = normalised_leaf(F.try_parse_json(piece))
        return F.when(piece.rlike("^-?[0-9]"), F.coalesce(F.substring(spelled, F.lit(3), F.length(spelled)), piece)).otherwise(piece)

    return (
        F.when(compact.isNull() | compact.isin("{}", "[]"), F.lit(""))
        .when(compact.rlike(_SPELLED) & outside.rlike(_SPELLED), rewrite_scalars(compact, [_NO_WORD], lambda name: F.lit(False), number))
        .otherwise(compact)
    )
