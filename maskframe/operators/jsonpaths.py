"""Masking inside JSON documents, addressed by dotted paths."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.context import MaskContext, MaskError
from maskframe.functions import jsontext
from maskframe.functions.providers import check_providers, get_provider
from maskframe.functions.seeds import Seed, seed_hex
from maskframe.functions.text import nfc
from maskframe.operators import actions as act

REMOVE = "remove"


class JsonPlan:
    """Helper columns and the final expression for one JSON column.

    The document is taken apart once, as text, into the members of its object; the values found
    there are the ones that are replaced there. Whatever no path names stays to the letter, numbers and
    blanks included. A member that a path names is masked wherever its key occurs in the object,
    with what the last occurrence says; a field that is null or missing stays so.

    A document that is no JSON, or is nested too deeply to be taken apart, ends the job with an error
    that names only the column. So does a list of objects, which paths cannot address.
    """

    def __init__(
        self,
        source: Column,
        action: act.JsonMask,
        ctx: MaskContext,
        path: str,
        helper: str,
        define: Callable[[Column], Column],
    ) -> None:
        self._source, self._action, self._ctx, self._path = source, action, ctx, path
        self._define = define
        self._tree = _tree_of(action.paths)
        if action.schema is not None:
            _check_schema(action, path)
        self.parsed = jsontext.members(source).alias(f"{helper}_doc")
        self._doc = F.col(f"{helper}_doc")
        self.found: list[Column] = []
        self.texts: list[Column] = []
        self.seeds: list[Column] = []
        self._values: dict[str, Column | None] = {}
        for i, (json_path, rule) in enumerate(action.paths.items()):
            self._add(json_path, rule, f"{helper}_json{i}")

    def _is(self, member: Column, name: str) -> Column:
        return jsontext.key_is(member, name, self._action.ignore_case)

    def _found(self, members: Column, parts: list[str]) -> Column:
        """The value that a path leads to, as written."""
        hits = F.filter(members, lambda m: self._is(m, parts[0]))
        value = jsontext.let(hits, lambda h: F.get(F.get(h, F.size(h) - 1), F.lit(3)))
        if len(parts) == 1:
            return value
        return jsontext.let(value, lambda v: self._found(jsontext.members(v), parts[1:]))

    def _add(self, json_path: str, rule: act.Action | str, helper: str) -> None:
        if rule == REMOVE:
            return
        if isinstance(rule, act.Null):
            self._values[json_path] = None
            return
        full_path = f"{self._path}#json:{json_path}"
        found = jsontext.let(
            self._found(self._doc, json_path.split(".")),
            lambda v: F.when(F.startswith(v, F.lit('"')), jsontext.string_value(v)).when(v != "null", v),
        )
        self.found.append(found.alias(f"{helper}_found"))
        text = F.col(f"{helper}_text")
        if isinstance(rule, act.Hash):
            self.texts.append(F.col(f"{helper}_found").alias(f"{helper}_text"))
            salted = F.concat(F.lit(bytearray(self._ctx.salt.encode())), text.cast("binary"))
            self._values[json_path] = self._literal(text, F.sha2(salted, 256))
            return
        if not isinstance(rule, act.Fake):
            raise MaskError(f"{full_path}: json_mask supports fake, hash, null and remove")
        check_providers([(full_path, rule.provider)])
        # Empty text stays empty, and a missing field stays missing.
        self.texts.append(nfc(F.col(f"{helper}_found"), self._ctx.nfc).alias(f"{helper}_text"))
        seed_path = rule.seed_alias or full_path
        self.seeds.append(seed_hex(F.nullif(text, F.lit("")), self._ctx.salt, seed_path).alias(f"{helper}_seed"))
        seed = Seed(F.col(f"{helper}_seed"))
        fake = get_provider(rule.provider).fn(seed, F.nullif(text, F.lit("")), dict(rule.params), self._ctx)
        self._values[json_path] = self._literal(text, fake)

    def _literal(self, text: Column, masked: Column) -> Column:
        """The new value as it is written into the document, worked out before the members are walked through."""
        return self._define(F.when(text == "", '""').when(text.isNotNull(), jsontext.string_literal(masked)))

    def result(self) -> Column:
        doc, source = self._doc, self._source
        broken = F.raise_error(F.lit(f"{self._path}: not a JSON document")).cast("string")
        lists = F.raise_error(F.lit(f"{self._path}: a list of objects, which no path can name")).cast("string")
        is_object, is_list = jsontext.starts_with(source, "{"), jsontext.starts_with(source, "[")
        return (
            F.when(source.isNull() | (source == ""), source)
            .when(F.try_parse_json(source).isNull(), broken)
            .when(is_object, F.when(jsontext.is_whole(doc), self._patched(doc, self._tree, "")).otherwise(broken))
            .when(~jsontext.is_single_value(source), broken)
            .when(is_list & jsontext.holds_object(source), lists)
            .otherwise(source)
        )

    def _patched(self, parts: Column, tree: dict, prefix: str) -> Column:
        """The text of an object with the members that ``tree`` names masked, nulled or left out."""
        gone = [name for name, below in tree.items() if below == REMOVE]

        def kept(m: Column) -> Column:
            out = F.lit(True)
            for name in gone:
                out = out & ~self._is(m, name)
            return out

        def written(m: Column) -> Column:
            value = F.when(F.size(m) == 1, F.lit(""))  # what follows the members
            for name, below in tree.items():
                if below != REMOVE:
                    value = value.when(self._is(m, name), self._value(F.get(m, F.lit(3)), below, prefix + name))
            return F.concat(F.coalesce(F.concat(F.get(m, F.lit(1)), F.get(m, F.lit(2))), F.lit("")), value.otherwise(F.get(m, F.lit(3))))

        staying = F.filter(parts, kept) if gone else parts
        # The object's own brace stays in front, whichever member comes first now.
        first = F.when(F.size(parts) > 1, F.get(F.get(parts, F.lit(0)), F.lit(0))).otherwise("")
        texts = F.transform(
            staying, lambda m, i: F.concat(F.when((i == 0) & (F.size(m) > 1), F.lit("")).otherwise(F.get(m, F.lit(0))), written(m))
        )
        return F.concat(first, F.array_join(texts, ""))

    def _value(self, value: Column, below: dict | None, path: str) -> Column:
        if isinstance(below, dict):
            broken = F.raise_error(F.lit(f"{self._path}: not a JSON document")).cast("string")
            inner = jsontext.let(
                jsontext.members(value),
                lambda p: F.when(jsontext.is_whole(p), self._patched(p, below, path + ".")).otherwise(broken),
            )
            return F.when(F.startswith(value, F.lit("{")), inner).otherwise(value)
        masked = self._values[path]
        if masked is None:
            return F.lit("null")
        unmasked = F.raise_error(F.lit(f"{self._path}: a value of {path} cannot be masked")).cast("string")
        return F.when(value == "null", value).otherwise(F.coalesce(masked, unmasked))


def _tree_of(paths: Mapping[str, act.Action | str]) -> dict:
    """Paths as nested names; leaves say ``remove`` or nothing."""
    tree: dict = {}
    for path in paths:
        *parents, leaf = path.split(".")
        node = tree
        for part in parents:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise MaskError(f"json path {path!r} lies below another configured path")
        if leaf in node:
            raise MaskError(f"json path {path!r} lies above another configured path")
        node[leaf] = REMOVE if paths[path] == REMOVE else None
    return tree


def _check_schema(action: act.JsonMask, path: str) -> None:
    """Refuse paths that the declared schema does not have."""
    schema = T.StructType.fromDDL(action.schema)
    for json_path in action.paths:
        at: T.DataType = schema
        for part in json_path.split("."):
            if not isinstance(at, T.StructType) or part not in at.names:
                raise MaskError(f"{path}: the declared schema has no field {json_path!r}")
            at = at[part].dataType
