"""Personal data in texts, with DataFrame functions only.

A kind of data is a regular expression that proposes spans, a validator that confirms them (Luhn's
sum for cards, mod 97 for account numbers, ranges and digit counts for the rest) and words which,
near a span, raise or lower its score. Kinds with ``base`` keep every confirmed span whatever its
score; the others keep those that reach THRESHOLD.

A text is cut once at the matches of a kind: the pieces between them give both the positions, as
sums of lengths, and the words before and after. No position is searched for and no prefix of a
text is copied for a span, so the work is linear in the text and its matches. Repetitions in the
expressions are possessive where backing off could not help, so that a digit run of any length
neither recurses nor is tried again from its middle; the spans are those of the plain expressions
that ORACLE uses.

Everything is narrow: one pass over the rows, no shuffle, so hot sources, copies and lost executors
cost nothing. Null and empty texts have no spans. Very long texts are taken whole; a span may begin
or end anywhere in them. Spans of different kinds may overlap, those of one kind never do. Rows are
rows: repeated rows get the same result each, an empty table gives an empty one, and extra columns
are never read by ``personal_data`` and kept by ``masked``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hundredths: what a span that is not of a base kind has to score.
THRESHOLD = 50
#: Characters before and after a span in which context words count, up to its neighbours of the kind.
NEAR = 48
#: Positions are summed in runs of so many spans, then over the runs.
RUN = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(match: Column) -> Column:
    return F.translate(match, "+ ().-", "")


def _digit(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1)).cast("int")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, less 9 if that has two digits."""
    def total(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = _digit(s, i) * F.when(F.pmod(F.length(s) - i, F.lit(2)) == 1, 2).otherwise(1)
            return acc + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)

    return F.pmod(_let(digits, total), F.lit(10)) == 0


def mod_97(account: Column) -> Column:
    """The account number, its first four characters last and letters as 10 to 35, leaves 1."""
    def rest(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            c = F.ascii(F.substr(s, i, F.lit(1)))
            return F.when(c > 57, F.pmod(acc * 100 + c - 55, F.lit(97))).otherwise(F.pmod(acc * 10 + c - 48, F.lit(97)))

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)

    return _let(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), rest) == 1


def _ip(match: Column) -> Column:
    """Parts at most 255, however many zeros lead them."""
    def small(part: Column) -> Column:
        return _let(F.ltrim(part, F.lit("0")), lambda p: F.when(F.length(p) > 3, False).otherwise(F.coalesce(F.when(F.length(p) > 0, p).cast("int"), F.lit(0)) <= 255))

    return F.forall(F.split(match, "[.]", -1), small)


def _card(match: Column) -> Column:
    return _let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _iban(match: Column) -> Column:
    return _let(F.translate(match, " ", ""), lambda s: F.when(F.length(s).between(15, 34), mod_97(s)).otherwise(False))


def _ssn(match: Column) -> Column:
    area = F.substr(match, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.substr(match, F.lit(8), F.lit(4)) != "0000")


@dataclass(frozen=True)
class Kind:
    name: str
    #: For Java's engine.
    pattern: str
    #: The same spans, as plainly as it can be said.
    plain: str
    valid: Callable[[Column], Column]
    base: bool
    #: Hundredths; a context word adds or takes 30.
    score: int
    raised_by: str
    lowered_by: str
    #: Whether a letter, digit, + or - may touch the span.
    alone: bool = False


# Patterns, scores and context words.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: F.lit(True), True, 70,
         "mail|contact|write|kontakt|correo|courriel", "noreply|example"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _ip, True, 50,
         "address|server|host|login|from", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]([\x20-]?[0-9])+", _card, True, 60,
         "card|visa|credit|payment|karte|tarjeta|carte", "order|tracking|isbn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, True, 60,
         "phone|call|tel|mobile|fax|anruf", "score|version"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
         r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", _iban, False, 70,
         "iban|account|bank|konto|cuenta|compte", "example", True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, False, 30,
         "ssn|social security|tax id", "order|part", True),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
         lambda m: F.lit(True), False, 30, "phone|call|tel|mobile|fax", "order|invoice", True),
)


def _before(steps: Column) -> Column:
    """For each step, the sum of those before it: in runs of RUN, then over the runs."""
    def run(g: Column) -> Column:
        return F.slice(steps, g * RUN + 1, F.lit(RUN))

    def extended(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    zero = F.lit(0).cast("bigint")
    groups = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))
    sums = F.transform(groups, lambda g: F.aggregate(run(g), zero, lambda acc, x: acc + x))
    starts = F.aggregate(sums, F.array(zero), extended)

    def inside(begin: Column, g: Column) -> Column:
        return F.slice(F.aggregate(run(g), F.array(begin), extended), F.lit(1), F.size(run(g)))

    return _let(starts, lambda at: F.flatten(F.transform(groups, lambda g: inside(F.get(at, g), g))))


def _scored(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    up, down = (F.when(near.rlike(p), 30).otherwise(0) for p in (kind.raised_by, kind.lowered_by))
    return (F.lit(kind.score) + up - down).cast("int")


def _holds(kind: Kind, match: Column, before: Column, after: Column) -> Column:
    ok = kind.valid(match)
    if kind.alone:
        ok = ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9+-]") & ~F.left(after, F.lit(1)).rlike("[A-Za-z0-9+-]") & ok
    return ok


def _matches(text: Column, kind: Kind) -> Column:
    return F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """The kind's confirmed spans with their scores, in order."""
    def placed(both: Column) -> Column:
        match, piece = both["match"], both["piece"]
        steps = F.transform(match, lambda m, i: (F.length(F.get(piece, i)) + F.length(m)).cast("bigint"))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(piece, i))
            score = F.when(_holds(kind, m, F.get(piece, i), F.get(piece, i + 1)), _scored(kind, F.get(piece, i), F.get(piece, i + 1)))
            return F.struct(start.alias("start"), F.lit(number).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), m.alias("match"), score.alias("score"), F.lit(kind.base).alias("base"))

        each = _let(steps, lambda s: _let(_before(s), lambda b: F.transform(match, lambda m, i: span(m, i, b))))
        return F.filter(each, lambda s: s["score"].isNotNull() if kind.base else s["score"] >= THRESHOLD)

    def some(match: Column) -> Column:
        both = F.struct(match.alias("match"), F.split(text, kind.pattern, -1).alias("piece"))
        return F.when(F.size(match) > 0, _let(both, placed))

    return _let(_matches(text, kind), some)


def spans_of(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The personal data of a text: start, rank of the kind, end (code points, end exclusive), kind,
    match, score (hundredths) and base, sorted by start and kind."""
    text = F.coalesce(text, F.lit(""))
    each = [_spans(text, k, kind) for k, kind in enumerate(kinds)]
    return F.sort_array(F.flatten(F.filter(F.array(*each), lambda s: s.isNotNull())))


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans; one row a document."""
    return docs.select("doc_id", spans_of(F.col("text"), kinds).alias("spans"))


def masked(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The text with each span replaced by its kind in brackets, kind after kind; null stays null."""
    for kind in kinds:
        text = _masked(text, kind)
    return text


def _masked(text: Column, kind: Kind) -> Column:
    def shown(piece: Column, m: Column, i: Column) -> Column:
        before, after = F.get(piece, i), F.get(piece, i + 1)
        keep = _holds(kind, m, before, after)
        if not kind.base:
            keep = keep & (_scored(kind, before, after) >= THRESHOLD)
        return F.concat(before, F.when(keep, F.lit(f"[{kind.name}]")).otherwise(m))

    def joined(both: Column) -> Column:
        piece = both["piece"]
        return F.concat(F.array_join(F.transform(both["match"], lambda m, i: shown(piece, m, i)), ""), F.element_at(piece, -1))

    def changed(pair: Column) -> Column:
        both = F.struct(pair["match"].alias("match"), F.split(pair["text"], kind.pattern, -1).alias("piece"))
        return F.when(F.size(pair["match"]) > 0, _let(both, joined)).otherwise(pair["text"])

    return _let(text, lambda t: _let(F.struct(t.alias("text"), _matches(t, kind).alias("match")), changed))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row a document: doc_id, a count for each base kind, base_sha256, spans, n_added, and
    best_score, the highest of the spans' scores (null without spans)."""
    found = personal_data(docs, kinds)
    s = F.col("spans")
    base = F.filter(s, lambda x: x["base"])

    def count(k: int) -> Column:
        return F.size(F.filter(s, lambda x: x["rank"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{kind.name}") for k, kind in enumerate(kinds) if kind.base]
    added = F.size(F.filter(s, lambda x: ~x["base"])).cast("bigint")
    best = F.array_max(F.transform(s, lambda x: x["score"]))
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(s).alias("spans"), added.alias("n_added"), best.alias("best_score"))


def _oracle() -> str:
    """DuckDB SQL from the plain expressions: pieces and matches as rows, positions as window sums."""
    digits = "translate(m, '+ ().-', '')"
    luhn_sql = (f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
                f"CASE WHEN (length({digits}) - i) % 2 = 0 THEN substr({digits}, i, 1)::INT "
                f"WHEN 2 * substr({digits}, i, 1)::INT > 9 THEN 2 * substr({digits}, i, 1)::INT - 9 ELSE 2 * substr({digits}, i, 1)::INT END)) % 10 = 0")
    account = "replace(m, ' ', '')"
    moved = f"(substr({account}, 5) || substr({account}, 1, 4))"
    mod_sql = (f"length({account}) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(string_split({moved}, ''), lambda c: "
               "CASE WHEN ascii(c) > 57 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1")
    valid = {
        "email": "true", "local_phone": "true", "card": luhn_sql, "iban": mod_sql, "phone": f"length({digits}) BETWEEN 10 AND 15",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "ssn": "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 3) < '900' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'",
    }
    parts = []
    for k, kind in enumerate(KINDS):
        touch = " AND NOT regexp_matches(right(before, 1), '[A-Za-z0-9+-]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9+-]')" if kind.alone else ""
        near = f"lower(right(before, {NEAR}) || ' ' || left(after, {NEAR}))"
        score = f"{kind.score} + CASE WHEN regexp_matches({near}, '{kind.raised_by}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches({near}, '{kind.lowered_by}') THEN 30 ELSE 0 END"
        parts.append(
            f"SELECT row_no, {k} AS rank, '{kind.name}' AS kind, {'true' if kind.base else 'false'} AS base, pos AS start, pos + length(m) AS stop, {score} AS score "
            f"FROM (SELECT row_no, unnest(ms) AS m, unnest(list_slice(ps, 1, len(ms))) AS before, unnest(list_slice(ps, 2, len(ms) + 1)) AS after, unnest(starts) AS pos "
            f"FROM (SELECT row_no, ms, ps, list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0)) AS starts "
            f"FROM (SELECT row_no, regexp_extract_all(t, '{kind.plain}') AS ms, string_split_regex(t, '{kind.plain}') AS ps FROM d) WHERE len(ms) > 0)) "
            f"WHERE {valid[kind.name]}{touch}")
    joined = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind.name}') AS n_{kind.name}" for kind in KINDS if kind.base)
    return (
        "WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + "), "
        f"k AS (SELECT row_no, rank, kind, base, start, stop, score FROM s WHERE base OR score >= {THRESHOLD}) "
        f"SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256({joined.format(' FILTER (base)')}) AS base_sha256, {joined.format(' FILTER (kind IS NOT NULL)')} AS spans, "
        "count(*) FILTER (NOT base) AS n_added, max(score)::INT AS best_score FROM d LEFT JOIN k ON k.row_no = d.row_no GROUP BY d.row_no")


#: The same in DuckDB SQL.
ORACLE = _oracle()
