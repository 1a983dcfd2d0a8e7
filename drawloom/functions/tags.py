"""Predicates and parsers of tags, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawloom import config
from drawloom.config import RULES, Rules
from drawloom.functions import text as T

TAG = "struct<full_tag:string,root:string,component:string,tag_class:string>"


def looks_asset(norm: Column, p: Rules = RULES) -> Column:
    """Letters and at least four digits; not denied, and no instrument code unless it is equipment too."""
    prefix = T.alpha_prefix(norm)
    shaped = norm.rlike(config.ASSET_TAG) & norm.rlike("^[A-Z]+[0-9]{4,}")
    only_code = prefix.isin(*p["grammar"]["isa"]) & ~prefix.isin(*p["grammar"]["equipment"])
    return shaped & ~prefix.isin(*p["grammar"]["deny"]) & ~only_code


def looks_hyphen_root(norm: Column) -> Column:
    return norm.rlike(config.HYPHEN_ROOT) | norm.rlike(config.COMPACT_ROOT)


def looks_root(norm: Column, p: Rules = RULES) -> Column:
    return looks_asset(norm, p) | looks_hyphen_root(norm)


def looks_isa_child(norm: Column, p: Rules = RULES) -> Column:
    return F.regexp_extract(norm, config.ISA_CHILD, 1).isin(*p["grammar"]["isa"])


def looks_equipment_child(norm: Column, p: Rules = RULES) -> Column:
    return F.regexp_extract(norm, config.EQUIPMENT_CHILD, 1).isin(*p["grammar"]["equipment"])


def looks_child(norm: Column, p: Rules = RULES) -> Column:
    return looks_isa_child(norm, p) | looks_equipment_child(norm, p)


def canonical_root(c: Column) -> Column:
    return F.regexp_replace(F.translate(T.normalize_token(c), " ", "-"), config.COMPACT_ROOT, "$1-$2-$3")


def compact_child(norm: Column) -> Column:
    """LIT-01 to LIT01; anything else unchanged."""
    return F.regexp_replace(norm, config.ISA_CHILD, "$1$2$3")


def instrument_code(component: Column) -> Column:
    code = F.regexp_extract(component, config.ISA_CHILD, 1)
    return F.when(code != "", code).otherwise(T.alpha_prefix(component))


def line_tag(upper: Column) -> Column:
    """Parsed size-service-number of the first line tag in upper-case text, spec tail dropped; null where none."""
    size, body = (F.regexp_extract(upper, config.LINE_TAG, i) for i in (1, 2))
    parts = F.split(T.normalize_token(body), "-")
    pipe = T.normalize_pipe_size(size)
    stem = F.concat(parts[0], F.lit("-"), parts[1])
    full = F.when(pipe != "", F.concat(pipe, F.lit('"-'), stem)).otherwise(stem)
    return F.when(body != "", _tag(full, parts[0], parts[1], F.lit("line")))


def _tag(full: Column, root: Column, component: Column, kind: Column) -> Column:
    return F.struct(full.alias("full_tag"), root.alias("root"), component.alias("component"), kind.alias("tag_class"))


def _joined(parts: Column, drop: int) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0))), "-")


def parse_tag(cell: Column, p: Rules = RULES) -> Column:
    """The tag that a spreadsheet cell names, or null.

    Tried in turn: line tag, hyphen root, instrument tail of two then one
    part, equipment tail, any code-number tail, two-part line, asset.
    """
    raw = F.trim(cell.cast("string"))
    norm = F.translate(T.normalize_token(T.strip_pipe_size(raw)), " ", "-")
    norm = F.trim(F.regexp_replace(norm, "-+", "-"), F.lit("-"))

    def parsed(n: Column) -> Column:
        parts = F.split(n, "-")
        count = F.size(parts)
        one, two = F.element_at(parts, -1), F.array_join(F.slice(parts, F.greatest(count - 1, F.lit(1)), F.lit(2)), "-")
        child, root = F.lit("instrument"), F.lit("equipment")

        def tail(part: Column, drop: int, kind: Column, comp: Column) -> Column:
            at = canonical_root(_joined(parts, drop))
            return _tag(F.concat(at, F.lit("-"), comp), at, comp, kind)

        whole = _tag(canonical_root(n), canonical_root(n), F.lit(""), root)
        several = count >= 2
        is_line = (count == 2) & parts[0].rlike(r"^\p{L}+$") & F.get(parts, F.lit(1)).rlike("[0-9]")
        return (
            F.when((n == "") | T.alpha_prefix(parts[0]).isin(*p["grammar"]["deny"]), F.lit(None).cast(TAG))
            .when(looks_hyphen_root(n), whole)
            .when(several & looks_isa_child(two, p), tail(two, 2, child, compact_child(two)))
            .when(several & looks_isa_child(one, p), tail(one, 1, child, compact_child(one)))
            .when(several & looks_equipment_child(one, p), tail(one, 1, root, one))
            .when(several & two.rlike(config.ISA_CHILD), tail(two, 2, child, compact_child(two)))
            .when(several & one.rlike(config.ISA_CHILD), tail(one, 1, child, compact_child(one)))
            .when(several & is_line, _tag(n, parts[0], F.get(parts, F.lit(1)), F.lit("line")))
            .when(looks_asset(n, p), whole)
        )

    line = line_tag(F.upper(raw))
    found = F.transform(F.array(norm), parsed)[0]
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast(TAG)).otherwise(F.coalesce(line, found))


def full_hyphen_tag(token: Column, p: Rules = RULES) -> Column:
    """(full_tag, root, component, tag_class, method) of a pre-joined tag, or null."""
    none = F.lit(None).cast("struct<full_tag:string,root:string,component:string,tag_class:string,method:string>")

    def made(root: Column, comp: Column, kind: str, method: str) -> Column:
        return F.struct(
            F.concat(root, F.lit("-"), comp).alias("full_tag"),
            root.alias("root"),
            comp.alias("component"),
            F.lit(kind).alias("tag_class"),
            F.lit(method).alias("method"),
        )

    def ended(parts: Column) -> Column:
        """The last part and the last two, each with the root before it."""
        two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "-")
        roots = [canonical_root(_joined(parts, n)).alias(f"root_{n}") for n in (1, 2)]
        return F.struct(parts.alias("parts"), F.element_at(parts, -1).alias("one"), two.alias("two"), *roots)

    def read(t: Column) -> Column:
        denied = (F.size(t["parts"]) < 3) | T.alpha_prefix(t["parts"][0]).isin(*p["grammar"]["deny"])
        two = F.when(looks_root(t["root_2"], p), made(t["root_2"], compact_child(t["two"]), "instrument", "fulltag:isa"))
        one = F.when(looks_root(t["root_1"], p), made(t["root_1"], compact_child(t["one"]), "instrument", "fulltag:isa"))
        return (
            F.when(denied, none)
            .when(looks_isa_child(t["two"], p), two)
            .when(looks_isa_child(t["one"], p), one)
            .when(looks_equipment_child(t["one"], p), made(t["root_1"], t["one"], "equipment", "fulltag:equip"))
        )

    return F.transform(F.transform(F.array(F.split(token, "-")), ended), read)[0]  # binds what is used several times


def rating(confidence: Column, p: Rules = RULES) -> Column:
    return F.when(confidence >= p["score"]["ratings"]["High"], "High").when(confidence >= p["score"]["ratings"]["Medium"], "Medium").otherwise("Low")


def method_rank(method: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in config.METHOD_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, method), F.lit(9))


def sheet_family(sheet_id: Column, title: Column) -> Column:
    t, number = F.upper(F.coalesce(title, F.lit(""))), F.substring(sheet_id, 3, 10).try_cast("int")
    room = t.contains("MDF") | t.contains("IDF")
    return (
        F.when(t.contains("SWITCH-SCHEDULES") | t.contains("SWITCH SCHEDULES"), "switch_schedule")
        .when(t.contains("FIBER-SCHEDULES") | t.contains("FIBER SCHEDULES"), "fiber_schedule")
        .when(room & t.contains("SCHEDULE"), "schedule")
        .when(room & (t.contains("LAYOUT") | t.contains("DETAIL")), "mdf_idf_layout")
        .when(number.isNull(), "unknown")
        .when(number < 1000, "general_notes")
        .when(number.between(1000, 1999), "overall_plan")
        .when(number.between(4000, 4999), "area_plan")
        .when(number.between(5000, 5999), "detail")
        .when(number.isin(6001, 6002) | number.between(6101, 6109), "schedule")
        .when(number.between(6000, 6999), "mdf_idf_layout")
        .otherwise("unknown")
    )


def revision_status(before: Column, after: Column) -> Column:
    """How two revision marks relate; marks equal but for case and blanks are the same."""
    b, a = T.revision_value(before), T.revision_value(after)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    equal = some(before) & some(after) & (F.lower(F.trim(before)) == F.lower(F.trim(after)))
    return (
        F.when(equal, "same_revision")
        .when(a > b, "revised")
        .when(a < b, "revision_regressed")
        .when(a == b, "same_revision")
        .when(some(before) | some(after), "revision_unknown")
        .otherwise("no_revision")
    )


def direction(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """(order, method): -1 if left is the earlier, 1 if right is; null where nothing tells.

    Tried in turn: revision, version, latest date, time of change over an hour apart.
    """
    rev = T.revision_value(left["revision"]), T.revision_value(right["revision"])
    version = left["version"], right["version"]
    dates = F.array_max(left["dates"]), F.array_max(right["dates"])
    changed = left["modified_at"], right["modified_at"]

    def ordered(pair: tuple[Column, Column], method: str) -> Column:
        order = F.when(pair[0] < pair[1], F.lit(-1)).otherwise(F.lit(1))
        return F.struct(order.alias("order"), F.lit(method).alias("method"))

    return (
        F.when(rev[0] != rev[1], ordered(rev, "revision-order"))
        .when(version[0] != version[1], ordered(version, "version-order"))
        .when(dates[0] != dates[1], ordered(dates, "date-order"))
        .when(F.abs(changed[0] - changed[1]) > 3600, ordered(changed, "modified-time"))
    )
