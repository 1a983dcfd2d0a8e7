"""Finding and sanitising personal data.

Base kinds (email, ip, card, phone) are found by pattern, leftmost and without
overlap in each kind; ``secret`` adds long opaque strings (letters and digits
mixed, many different characters).  The information-theoretic part then asks
which other terms give a protected entity away.  Entities are the values that
were found and the kinds themselves (that a text holds a secret is protected
too).  From the corpus it estimates, for an entity c and a term t that stand near each
other,

    disclosure(c, t) = PMI(c; t) / IC(c) = 1 + log2 p(c | t) / -log2 p(c)

with p(c) the share of distinct texts that hold c and p(c | t) the distinct
texts that hold both c and t, wherever they stand, over those that hold t.  It
is 1 when the term always comes with the entity.  Terms at ``generalise`` or more are
replaced by their shape, at ``remove`` or more they are removed, wherever they
occur.  A pair is tried when t stands beside c in ``support`` distinct contexts,
so that copies of one text, which repeat one context, prove nothing.

Contexts hold at most ``reach`` characters on either side of a value.  Counts
per entity and per term leave each task as partial sums, and entities or terms
that very many pairs share are joined by broadcast, so a value in a third of all
rows is no hot spot.  All counts run over whole texts, copies of a text once.

Nulls: a null text is empty; a null doc_id is allowed; repeated rows are rows
of their own (they share contexts).  Without matches, or in an empty
table, the method adds nothing.  Texts of any length are searched whole, in
linear time.  Equal disclosures of a term take the same action; a term that
several entities share has the highest.  Columns other than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import BROADCAST_ROWS, cut, let, lookup, running_ends, sized_broadcast, text_of

KINDS = ("email", "ip", "card", "phone")
#: Each starts only where a maximal run starts or the match before ended, so long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9]{16}"}
FOUND = (*KINDS, "secret")
#: Least different characters of a secret; a random string of sixteen hexadecimal digits has ten in the mean.
VARIETY = 8
TERM = r"[\p{L}\p{N}]"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,left:string,right:string>>"
PARTS_255 = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def located(text: Column, pattern: Column | str, kind: str, reach: int = 0) -> Column:
    """The matches of ``pattern`` with their places in code points and ``reach`` characters around them.

    Words that the cut or a match splits are left out of the characters around.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def bare(around: Column, head: Column, tail: Column) -> Column:
        """Without the word at either edge that goes on beyond it."""
        around = F.when(head, F.regexp_replace(around, f"^{TERM}+", "")).otherwise(around)
        return F.when(tail, F.regexp_replace(around, f"{TERM}+$", "")).otherwise(around)

    def ends(value: Column) -> Column:
        return F.coalesce(value.rlike(f"{TERM}$"), F.lit(False))

    def starts(value: Column) -> Column:
        return F.coalesce(value.rlike(f"^{TERM}"), F.lit(False))

    def before(gap: Column, last: Column, value: Column) -> Column:
        if not reach:
            return F.lit("")
        long = F.length(gap) > reach  # one character more shows whether the cut splits a word
        kept = F.substring(gap, -F.least(F.lit(reach + 1), F.length(gap)), F.lit(reach + 1))
        return bare(kept, long | ends(last), starts(value))

    def after(gap: Column, value: Column, following: Column) -> Column:
        if not reach:
            return F.lit("")
        return bare(F.substring(gap, F.lit(1), F.lit(reach + 1)), ends(value), (F.length(gap) > reach) | starts(following))

    def with_gaps(m: Column) -> Column:
        def spans(gaps: Column) -> Column:
            lengths = F.transform(m, lambda x, i: (F.length(gaps[i]) + F.length(x)).cast("bigint"))
            return let(
                running_ends(lengths),
                lambda ends: F.transform(
                    m,
                    lambda x, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (ends[i] - F.length(x)).alias("start"),
                        ends[i].alias("end"),
                        x.alias("value"),
                        before(gaps[i], F.get(m, i - 1), x).alias("left"),
                        after(gaps[i + 1], x, F.get(m, i + 1)).alias("right"),
                    ),
                ),
            )

        return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, F.lit(-1)), spans))

    return let(found, with_gaps)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)

    def one(acc: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), one) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PARTS_255}(?:\.{PARTS_255}){{3}}$")
    if kind == "secret":
        mixed = value.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
        return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str, reach: int = 0) -> Column:
    hinted = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    spans = located(text, PATTERNS[kind], kind, reach)
    return F.when(hinted, F.filter(spans, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def _terms(text: Column) -> Column:
    parts = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda t: t.rlike(r"\p{L}"))  # numbers are values, or parts of them


def disclosing_terms(
    docs: DataFrame, *, reach: int = 64, support: int = 3, generalise: float = 0.9, remove: float = 0.97
) -> DataFrame:
    """(term, action, disclosure) of the terms that give a protected entity away, from (text)."""
    keyed = docs.select(F.xxhash64("text").alias("h"), "text")
    spans = keyed.select("h", F.explode(F.concat(*[base_spans(F.col("text"), k, reach) for k in FOUND])).alias("s"))
    plain = F.when(F.col("s.kind") == "email", F.lower("s.value")).when(F.col("s.kind").isin("ip", "secret"), F.col("s.value"))
    value = F.concat_ws(":", "s.kind", plain.otherwise(F.regexp_replace("s.value", "[^0-9]", "")))
    around = F.concat_ws(" ", "s.left", "s.right")
    near = spans.select("h", value.alias("value"), F.col("s.kind").alias("kind"), around.alias("around"))
    near = cut(near.distinct())  # copies of a text leave here
    entities = near.select("h", "around", F.explode(F.array("value", "kind")).alias("entity"))
    holders = entities.select("entity", "h").distinct()
    held = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("docs_c")).filter(F.col("docs_c") >= support)
    held = cut(held)
    contexts = entities.select("entity", "around").distinct()
    pairs = contexts.select("entity", F.explode(F.array_distinct(_terms(F.col("around")))).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= support)
    n_texts = keyed.select("h").distinct().count()
    information = -F.log2(F.col("docs_c") / F.lit(float(n_texts)))

    def share(joint: str, docs_t: str) -> Column:
        given = F.least(F.lit(1.0), F.col(joint) / F.col(docs_t))
        return F.when(information > 0, 1 + F.log2(given) / information).otherwise(F.lit(0.0))

    # Texts with entity and term are at most those with the entity, and texts that hold a term near any value
    # are at most those that hold it at all, so a pair whose share stays under the threshold with these
    # bounds stays under it with the counts: only others are counted.  Kinds are held by too many texts for that.
    nearby = near.select("h", F.explode(F.array_distinct(_terms(F.col("around")))).alias("term")).distinct()
    nearby = cut(nearby.groupBy("term").agg(F.count(F.lit(1)).alias("docs_near")).filter(F.col("docs_near") >= support))
    pairs = cut(lookup(pairs, held, "entity", None, held.count()))
    kinds = pairs.filter(F.col("entity").isin(*FOUND)).select("entity", "term", "docs_c")
    pairs = pairs.filter(~F.col("entity").isin(*FOUND))
    pairs = lookup(pairs, nearby, "term", None, nearby.count()).filter(share("docs_c", "docs_near") >= generalise)
    pairs = cut(pairs.select("entity", "term", "docs_c"))
    n_pairs = pairs.count()
    counted = _with_counts(keyed, kinds)
    if n_pairs:
        seen = keyed.select("h", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
        seen = cut(seen.join(sized_broadcast(pairs.select("term").distinct(), n_pairs), "term", "left_semi").distinct())
        counts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("docs_t"))
        both = seen.join(holders, "h").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint"))
        own = both.join(sized_broadcast(pairs, n_pairs), ["entity", "term"]).join(counts, "term")
        counted = counted.unionByName(own.select("term", "docs_c", "joint", "docs_t"))
    scored = counted.filter("joint > 0").groupBy("term").agg(F.max(share("joint", "docs_t")).alias("disclosure"))
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    return cut(scored.filter(F.col("disclosure") >= generalise).select("term", action.alias("action"), "disclosure"))


def _with_counts(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(term, docs_c, joint, docs_t) of pairs of a kind and a term: distinct texts with both and with the term.

    A kind stands in very many texts, so nothing is dealt out by text: every
    copy of a text counts for its share, and sums leave each task by term.
    """
    copied = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = cut(copied.withColumn("part", 1.0 / F.col("n")))
    n_copied, n_rows = copied.agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = cut(pairs.select("term").distinct())
    n_wanted = wanted.count()
    rows = keyed.select("h", F.array_distinct(_terms(F.col("text"))).alias("terms"), *[_has(F.col("text"), k).alias(f"has_{k}") for k in FOUND])
    rows = lookup(rows, copied, "h", "n", n_copied, n_rows or 0)
    terms = rows.select(F.explode("terms").alias("term"), F.coalesce("part", F.lit(1.0)).alias("part"), *[f"has_{k}" for k in FOUND])
    if n_wanted <= BROADCAST_ROWS:
        terms = terms.join(F.broadcast(wanted), "term", "left_semi")
    whole = lambda c: F.round(F.sum(c)).cast("long")
    counts = terms.groupBy("term").agg(
        whole("part").alias("docs_t"), *[whole(F.when(F.col(f"has_{k}"), F.col("part")).otherwise(0.0)).alias(k) for k in FOUND]
    )
    joined = counts.unpivot(["term", "docs_t"], list(FOUND), "entity", "joint").join(pairs, ["entity", "term"])
    return joined.select("term", "docs_c", "joint", "docs_t")


def _has(text: Column, kind: str) -> Column:
    """Whether a text holds a valid value of a kind."""
    hinted = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    return hinted & F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda v: _valid(kind, v))


def find_personal_data(docs: DataFrame, **options: float) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_spans, base_sha256, spans, clean_text.

    ``spans`` lists kind:start:end in the order of KINDS, then secrets, then
    terms; ``clean_text`` has the spans of values replaced by their kind and the
    disclosing terms generalised to their shape or removed.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    risky = disclosing_terms(rows.select("text"), **options)
    found = rows.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(f"s_{k}") for k in FOUND])
    apart = F.concat(*[F.col(f"s_{k}") for k in KINDS])  # a card inside of a longer string is no secret
    found = found.withColumn("s_secret", F.filter("s_secret", lambda t: ~F.exists(apart, lambda b: _meet(b, t))))
    n_risky = risky.count()
    if n_risky:
        found = _with_terms(found, risky, n_risky)
    else:
        found = found.withColumn("s_term", F.array().cast(SPAN)).withColumn("removed", F.array().cast("array<string>"))
    kinds = (*FOUND, "term")
    listed = [F.transform(f"s_{k}", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in kinds]
    every = F.concat(*[F.col(f"s_{k}") for k in kinds])
    return found.select(
        "doc_id",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in kinds],
        F.size(every).cast("long").alias("n_spans"),
        F.sha2(F.array_join(F.concat(*listed[: len(KINDS)]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*listed), ",").alias("spans"),
        clean(F.col("text"), every, F.col("removed")).alias("clean_text"),
    )


def _meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _with_terms(found: DataFrame, risky: DataFrame, n_risky: int) -> DataFrame:
    """Add the spans of the risky terms that overlap no base span, and which of them are removed."""
    keyed = found.withColumn("h", F.xxhash64("text"))
    held = keyed.select("doc_id", "h", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    held = held.join(sized_broadcast(risky, n_risky), "term")
    held = held.groupBy(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).agg(
        F.array_sort(F.collect_set("term")).alias("terms"),
        F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("removed"),
    )
    held = cut(held)
    same = (keyed["h"] == held["h_"]) & keyed["doc_id"].eqNullSafe(held["id_"])
    joined = keyed.join(sized_broadcast(held, held.count()), same, "left")
    pattern = F.concat(F.lit(f"(?iu)(?<!{TERM})(?:"), F.array_join("terms", "|"), F.lit(f")(?!{TERM})"))
    spans = F.when(F.col("terms").isNull(), F.array().cast(SPAN)).otherwise(located(F.col("text"), pattern, "term"))
    base = F.concat(*[F.col(f"s_{k}") for k in FOUND])
    return (
        joined.withColumn("base", base)
        .withColumn("all_terms", spans)
        .withColumn(
            "s_term",
            F.filter(
                "all_terms",
                lambda t: ~F.exists("base", lambda b: _meet(b, t)),
            ),
        )
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<string>")))
    )


def clean(text: Column, spans: Column, removed: Column) -> Column:
    """``text`` with its spans replaced; of overlapping spans the one that starts first, then the longest, counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"), s["value"].alias("value"))))
    blank = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    shape = lambda v: F.when(v.rlike("^[0-9]+$"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")

    def step(acc: Column, s: Column) -> Column:
        gone = F.array_contains(removed, F.lower(s["value"]))
        new = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(gone, "").otherwise(shape(s["value"]))
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        taken = F.struct((-s["to"]).alias("at"), F.concat(acc["out"], F.array(before, new)).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    def finish(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["out"], ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, blank, step, finish))
