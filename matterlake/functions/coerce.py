"""Coercion of loosely typed input into the stored shapes."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.functions import text as X

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
USER_PREFIX = "user:"
USER_SOURCE = "user"
SYSTEM_SOURCE = "system"


def clamp_confidence(c: Column) -> Column:
    """A number in [0, 1]; anything that is not a number counts as 0."""
    shown = X.trim_blanks(c.cast("string"))
    number = F.when(F.regexp_like(shown, F.lit(NUMBER)), shown.try_cast("double"))
    endless = F.when(shown.isin("Infinity", "+Infinity"), F.lit(1.0))
    return F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, endless, F.lit(0.0)))
    )


def one_of(c: Column, allowed: Iterable[str], default: str | None) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def position_status(c: Column) -> Column:
    return one_of(c, S.POSITION_STATUSES, "open")


def party_role(c: Column) -> Column:
    return one_of(c, S.PARTY_ROLES, None)


def is_json_container(c: Column) -> Column:
    """The text is a JSON object or array."""
    opener = F.substring(X.trim_blanks(c), 1, 1)
    parsed = F.try_parse_json(c)
    return F.coalesce(opener.isin("{", "[") & parsed.isNotNull(), F.lit(False))


def json_value(c: Column) -> Column:
    """JSON containers stay; any other text becomes ``{"raw": text}``."""
    raw = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("raw")))
    return F.when(is_json_container(c), c).otherwise(raw)


def _text_field(item: Column, name: str) -> Column:
    """A member of a variant object, only if it is a JSON string."""
    member = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(
        F.schema_of_variant(member) == "STRING",
        F.try_variant_get(item, f"$.{name}", "string"),
    )


def normalise_parties(c: Column) -> Column:
    """The ``parties`` JSON as ``array<struct<party_id, kind, role>>``."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    objects = F.filter(
        items, lambda v: F.regexp_like(F.schema_of_variant(v), F.lit("^(OBJECT|ARRAY)"))
    )

    def party(v: Column) -> Column:
        kind = _text_field(v, "kind")
        return F.struct(
            F.coalesce(
                _text_field(v, "partyId"),
                _text_field(v, "id"),
                _text_field(v, "name"),
                F.lit("unknown"),
            ).alias("party_id"),
            F.when(kind.isin(*S.PARTY_KINDS), kind)
            .otherwise("counterparty")
            .alias("kind"),
            F.coalesce(_text_field(v, "role"), F.lit("party")).alias("role"),
        )

    empty = F.from_json(
        F.lit("[]"), "array<struct<party_id:string,kind:string,role:string>>"
    )
    return F.coalesce(F.transform(objects, party), empty)


def counterparties(parties: Column) -> Column:
    """Ids of the parties on the other side."""
    others = F.filter(parties, lambda p: p["kind"] == "counterparty")
    return F.transform(others, lambda p: p["party_id"])


def involves(parties: Column, name: Column) -> Column:
    """Some counterparty id contains ``name``, whatever the case."""
    return F.exists(
        counterparties(parties), lambda p: X.contains_ignoring_case(p, name)
    )


def json_field(c: Column, name: str, default: str | None = None) -> Column:
    found = F.get_json_object(c, f"$.{name}")
    return found if default is None else F.coalesce(found, F.lit(default))


def asserted_by(extracted_by: Column) -> Column:
    return F.when(extracted_by.startswith(USER_PREFIX), USER_SOURCE).otherwise(
        SYSTEM_SOURCE
    )


def others_of(items: Column, chosen: Column, n: int | None = None) -> Column:
    """The non-null items that are not the chosen one, or the first ``n`` of them."""
    others = F.filter(F.array_compact(items), lambda x: x != chosen)
    return others if n is None else F.slice(others, 1, n)
