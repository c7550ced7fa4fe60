"""Personal data: overlapping candidate spans, boosted trees, calibrated redaction; DataFrame functions only.

All work stays inside a row. A text is cut into regions, runs of tokens that
hold a digit or an at sign, such that no base match or candidate crosses a
region's ends. In a region the base patterns are matched, generators propose
overlapping candidates, trees score them, and what a kind's threshold selects
is joined. Search and redaction are the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pii_model as M
from .common import LOWER, UPPER, fresh

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *M.KINDS]
#: What the base patterns match (fixed patterns), written without backtracking:
#: a start is only tried where a run begins or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A region, likewise: tokens with a digit or an at sign, or a spelled-out address, and spaces and lone signs between them.
_WORD = r"A-Za-z0-9._%+@():/-"
_SPELLED = r"(?:[A-Za-z0-9._%+-]++(?: ?\((?i:at)\) ?[A-Za-z0-9-]++(?:(?: ?\((?i:dot)\) ?| (?i:dot) |\.)[A-Za-z0-9-]++)++| (?i:at) [A-Za-z0-9-]++(?: (?i:dot) [A-Za-z0-9-]++)++))"
_TOKEN = rf"[A-Za-z._%+():/-]*+[0-9@][{_WORD}]*+"
REGION = (
    rf"(?:(?:\G|(?<![A-Za-z0-9._%+-])){_SPELLED}|(?:\G|(?<![{_WORD}])){_TOKEN})"
    rf"(?: ++(?:[().+-]++ ++)*(?:{_SPELLED}|{_TOKEN}))*+"
)
CONTEXT = M.CONTEXT
ITEM = "array<struct<kind:string,s:int,e:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def located(text: Column, pattern: str) -> Column:
    """A pattern's matches in order, leftmost and not overlapping: structs of s, e, m (the match), g (what stands before it)."""
    def placed(found: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string,g:string>>)").alias("out"))

        def add(state: Column, x: Column) -> Column:
            s = state["at"] + F.length(x["g"])
            e = s + F.length(x["m"])
            item = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["g"].alias("g"))
            return F.struct(e.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

        return F.aggregate(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("g")), start, add)["out"]

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(both, lambda b: placed(b["found"], b["between"]))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    back = F.reverse(digits)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda i: at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)
    worth = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, i: sum_ + F.when(i % 2 == 0, twice(i)).otherwise(at(i)))
    return worth % 10 == 0


def valid(kind: str, span: Column) -> Column:
    """The base's condition on a match."""
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda part: part.cast("double") <= 255)
    count = F.length(_digits(span))
    if kind == "card":
        return F.when(count.between(13, 19), luhn(_digits(span))).otherwise(F.lit(False))
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def _base(region: Column) -> Column:
    """The base spans of a region."""
    none = F.expr(f"cast(array() as {ITEM})")
    held = {"email": region.contains("@"), "ip": region.contains("."), "card": region.rlike("[0-9][ -]?[0-9]"), "phone": region.contains("+")}
    parts = []
    for kind, pattern in PATTERNS.items():
        found = F.filter(located(region, pattern), lambda x: valid(kind, x["m"]))  # noqa: B023
        item = lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))  # noqa: B023, E731
        parts.append(F.when(held[kind], F.transform(found, item)).otherwise(none))
    return F.concat(*parts)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _flag(text: Column, pattern: str) -> Column:
    return text.rlike(pattern).cast("int")


def _features(s: Column, e: Column, known: dict[str, Column], context: Column) -> Column:
    """A candidate: its place, what is ``known`` of its format, and its context's flags."""
    words = {name: _flag(context, pattern) for name, pattern in M.CONTEXT_WORDS.items()}
    known = known | words | {"glued": _flag(context, M.GLUED)}
    return F.struct(s.alias("s"), e.alias("e"), *(known.get(name, F.lit(0)).cast("int").alias(name) for name in M.FEATURES))


def _number_candidates(region: Column, before: Column) -> Column:
    """Every sub-run of up to MOST_GROUPS digit groups of 7 to 19 digits together."""

    def all_of(groups: Column) -> Column:
        def of_start(x: Column, i: Column) -> Column:
            near = F.when(i == 0, F.concat(before, x["g"])).otherwise(F.concat(F.try_element_at(groups, i)["m"], x["g"]))

            def of_count(context: Column) -> Column:
                def facts(n: Column) -> Column:
                    part = F.slice(groups, i + 1, n)
                    signs = F.array_join(F.transform(F.slice(part, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda y: y["g"]), "")
                    number = F.array_join(F.transform(part, lambda y: y["m"]), "")
                    longest = F.array_max(F.transform(part, lambda y: F.length(y["m"])))
                    after = F.try_element_at(groups, i + n + 1)["g"]
                    last = F.element_at(part, -1)
                    rest = F.coalesce(after, F.substring(region, last["e"] + 1, F.lit(3)))
                    return F.struct(
                        n.alias("n"), number.alias("number"), signs.alias("signs"), longest.alias("most"), last["e"].alias("e"),
                        F.length(last["m"]).alias("last"), rest.alias("rest"), after.isNotNull().alias("follows"),
                    )

                def candidate(f: Column) -> Column:
                    count = F.length(f["number"])
                    known = {
                        "digits": count, "groups": f["n"], "first": F.length(x["m"]), "last": f["last"], "most": f["most"],
                        "hyphens": _count(f["signs"], "-"), "dots": _count(f["signs"], "."), "spaces": _count(f["signs"], " "),
                        "bracket": _flag(F.concat(context, f["signs"]), M.BRACKET), "plus": _flag(context, M.PLUS),
                        "luhn": F.when(count.between(13, 19), luhn(f["number"]).cast("int")).otherwise(F.lit(0)),
                        "zero": _flag(f["number"], "^0"), "year": (F.length(x["m"]) == 4).cast("int") * _flag(x["m"], "^(19|20)"),
                        "inner": ((i > 0) & x["g"].rlike(M.BETWEEN)).cast("int"),
                        "more": (f["follows"] & f["rest"].rlike(M.BETWEEN)).cast("int"), "tail": _flag(f["rest"], M.TAIL),
                    }
                    return _features(x["s"], f["e"], known, context)

                counts = F.sequence(F.lit(1), F.least(F.lit(M.MOST_GROUPS), F.size(groups) - i))
                joined = F.filter(counts, lambda n: F.forall(F.slice(groups, i + 2, n - 1), lambda y: y["g"].rlike(M.BETWEEN)))
                sized = F.filter(F.transform(joined, facts), lambda f: F.length(f["number"]).between(M.LEAST_DIGITS, M.MOST_DIGITS))
                return F.transform(sized, candidate)

            return let(lowered(F.right(near, F.lit(CONTEXT))), of_count)

        return F.flatten(F.transform(groups, of_start))

    return let(located(region, "[0-9]+"), all_of)


def _token_candidates(region: Column, before: Column) -> Column:
    """Runs of letters, digits, hyphens and underscores of LEAST_TOKEN signs or more with a digit."""

    def candidate(x: Column) -> Column:
        context = lowered(F.right(F.when(x["s"] == F.length(x["g"]), F.concat(before, x["g"])).otherwise(x["g"]), F.lit(CONTEXT)))
        token = x["m"]
        known = {
            "token": F.lit(1), "length": F.least(F.length(token), F.lit(99)), "numbers": F.least(F.length(_digits(token)), F.lit(99)),
            "hex": _flag(token, "^([0-9a-f]+|[0-9A-F]+)$"), "turns": F.least(F.size(F.split(token, "[0-9]+", -1)) - 1, F.lit(99)),
            "hyphens": _count(token, "-"), "mixed": _flag(token, "[a-z]") + _flag(token, "[A-Z]"), "prefix": _flag(token, M.PREFIX),
        }
        return let(context, lambda c: _features(x["s"], x["e"], known, c))

    tokens = F.filter(located(region, M.TOKEN), lambda x: (F.length(x["m"]) >= M.LEAST_TOKEN) & x["m"].rlike("[0-9]"))
    return F.when(region.rlike(M.TOKEN_LONG), F.transform(tokens, candidate))


def _spelled_candidates(region: Column, before: Column) -> Column:
    """Addresses with their at sign or dots spelled out."""

    def candidate(x: Column) -> Column:
        context = lowered(F.right(F.when(x["s"] == F.length(x["g"]), F.concat(before, x["g"])).otherwise(x["g"]), F.lit(CONTEXT)))
        known = {
            "spelled": F.lit(1), "bracket": _flag(x["m"], r"\("), "length": F.least(F.length(x["m"]), F.lit(99)),
            "first": F.least(F.length(F.regexp_extract(x["m"], "^[^ (]*", 0)), F.lit(99)), "last": F.least(F.length(F.regexp_extract(x["m"], "[A-Za-z0-9-]*$", 0)), F.lit(99)),
            "stop": _flag(lowered(x["m"]), M.STOP),
        }
        return let(context, lambda c: _features(x["s"], x["e"], known, c))

    held = lowered(region).rlike(r"\(at\)| at ")
    return F.when(held, F.transform(located(region, rf"(?:\G|(?<![A-Za-z0-9._%+-])){_SPELLED}"), candidate))


def _score(kind: str, x: Column) -> Column:
    """A kind's trees, summed, less its threshold."""

    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(x[M.FEATURES[tree[0]]] <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

    trees, threshold = M.model()[kind]
    return reduce(lambda total, tree: total + walk(tree), trees, F.lit(-threshold))


def _added(region: Column, before: Column, base: Column) -> Column:
    """What the method adds in a region: accepted candidates no base span holds; those that overlap are joined."""
    digits = F.when(region.rlike(M.NUMBER_LONG), _number_candidates(region, before))
    none = F.expr(f"cast(array() as array<struct<s:int,e:int,{','.join(f'{n}:int' for n in M.FEATURES)}>>)")
    pool = F.concat(*(F.coalesce(c, none) for c in (digits, _token_candidates(region, before), _spelled_candidates(region, before))))
    free = F.filter(pool, lambda x: ~F.exists(base, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))

    def judged(x: Column) -> Column:
        scores = F.array(*(F.struct(_score(k, x).alias("p"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(M.KINDS)))
        return let(F.array_max(scores), lambda top: F.struct(x["s"].alias("s"), x["e"].alias("e"), top["p"].alias("p"), top["kind"].alias("kind")))

    chosen = F.array_sort(F.filter(F.transform(free, judged), lambda x: x["p"] > 0))
    return _united(chosen, lambda x: x["p"])


def _united(spans: Column, weight: Callable[[Column], Column]) -> Column:
    """Sorted spans (s, e, kind), those that overlap joined; the heaviest one's kind holds, the first of equals."""
    start = F.expr("struct(cast(array() as array<struct<kind:string,s:int,e:int>>) as out, cast(null as struct<kind:string,s:int,e:int,w:double>) as now)")
    plain = lambda now: F.struct(now["kind"].alias("kind"), now["s"].alias("s"), now["e"].alias("e"))

    def add(state: Column, x: Column) -> Column:
        w = weight(x).cast("double")
        now = state["now"]
        overlaps = now.isNotNull() & (x["s"] < now["e"])
        better = w > now["w"]
        grown = F.struct(
            F.when(better, x["kind"]).otherwise(now["kind"]).alias("kind"), now["s"].alias("s"),
            F.greatest(now["e"], x["e"]).alias("e"), F.greatest(now["w"], w).alias("w"),
        )
        fresh_one = F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), w.alias("w"))
        out = F.when(overlaps | now.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(plain(now))))
        return F.struct(out.alias("out"), F.when(overlaps, grown).otherwise(fresh_one).alias("now"))

    def finish(state: Column) -> Column:
        return F.when(state["now"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(plain(state["now"]))))

    return F.aggregate(spans, start, add, finish)


def _found(region: Column, before: Column) -> Column:
    """A region's spans, base ones first: structs of kind, s, e, within the region."""
    return let(_base(region), lambda base: F.concat(base, _added(region, before, base)))


def _with_regions(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and, as column ``name``, its regions: structs of s, m, g and ``found``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = F.when(text.rlike(r"[0-9@]| (?i:at) |\((?i:at)\)"), located(text, REGION))
    regions = F.coalesce(held, F.expr("cast(array() as array<struct<s:int,e:int,m:string,g:string>>)"))
    found = lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), x["g"].alias("g"), _found(x["m"], F.right(x["g"], F.lit(CONTEXT))).alias("found"))
    return docs.withColumn(name, regions).withColumn(name, F.transform(name, found))


def _spans(regions: Column) -> Column:
    """All spans of a text: structs of kind, s, e, counted in the text."""
    shifted = lambda x: F.transform(x["found"], lambda y: F.struct(
        y["kind"].alias("kind"), (x["s"] + y["s"]).cast("long").alias("start"), (x["s"] + y["e"]).cast("long").alias("end")
    ))
    return F.flatten(F.transform(regions, shifted))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, one row a span.

    Base matches that hold their condition stay as they are. Generators propose
    overlapping candidates: every sub-run of up to six digit groups, long tokens,
    addresses spelled out. Boosted trees over format and context score each for
    each added kind (payment, telephone, identity, secret, mail); above a kind's
    calibrated threshold it is accepted. Accepted candidates that overlap become
    one span; those inside a base span are none.
    """
    regions, spans = fresh(docs.select("doc_id", "text"), "_regions", "_spans")
    rows = _with_regions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), regions)
    return rows.select("doc_id", F.explode(_spans(F.col(regions))).alias(spans)).select("doc_id", f"{spans}.*")


def pii_scan(docs: DataFrame) -> DataFrame:
    """Every document's counts and spans, without a shuffle.

    Null and empty texts have none: zero counts, empty strings. A very long text
    is scanned whole, in time linear in it but for joining its regions' list.
    Repeated rows, also of one doc_id, are scanned each; a null doc_id is kept;
    ties of kinds go to the first in KINDS; other columns are not read. An empty
    table gives an empty result. Places are code points, ends exclusive. Returns
    doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.
    """
    rows = _with_regions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "regions")
    number = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    ordered = F.array_sort(F.transform(_spans(F.col("regions")), lambda x: F.struct(number(x).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda items: F.array_join(F.transform(items, shown), ",")
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.withColumn("all", ordered).select(
        "doc_id", *map(count, BASE),
        F.sha2(joined(F.filter("all", lambda x: x["k"] <= len(BASE))).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of :func:`pii_spans` replaced by its kind in brackets, in one pass over their places.

    Spans that overlap become one, named after the longest, the first of equals.
    Inside the row, so no shuffle; a text without spans, also a null or empty
    one, stays as it is; very long texts are redacted whole; repeated rows each.
    n_chars, if there, is set to the new length.
    """
    name, out = fresh(docs, "_regions", "_text")
    rows = _with_regions(docs, name)

    def cleaned(x: Column) -> Column:
        region = x["m"]
        spans = F.array_sort(F.transform(x["found"], lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["kind"].alias("kind"))))

        def rewrite(united: Column) -> Column:
            def piece(y: Column, i: Column) -> Column:
                since = F.coalesce(F.try_element_at(united, i)["e"], F.lit(0))
                return F.concat(F.substring(region, since + 1, y["s"] - since), F.lit("["), F.upper(y["kind"]), F.lit("]"))

            # try_element_at counts from 1, so place i is the span before; place 0 is no place.
            first = F.transform(F.slice(united, 1, 1), lambda y: F.concat(F.substring(region, F.lit(1), y["s"]), F.lit("["), F.upper(y["kind"]), F.lit("]")))
            others = F.slice(F.transform(united, lambda y, i: F.when(i > 0, piece(y, F.greatest(i, F.lit(1))))), F.lit(2), F.greatest(F.size(united) - 1, F.lit(0)))
            last = F.element_at(united, -1)["e"]
            return F.concat(F.array_join(F.concat(first, others), ""), F.substring(region, last + 1, F.length(region)))

        return F.concat(x["g"], F.when(F.size(spans) > 0, let(_united(spans, lambda y: y["e"] - y["s"]), rewrite)).otherwise(region))

    tail_at = F.coalesce(F.element_at(F.transform(name, lambda x: x["s"] + F.length(x["m"])), -1), F.lit(0))
    whole = F.concat(F.array_join(F.transform(name, cleaned), ""), F.substring("text", tail_at + 1, F.length("text")))
    hit = F.exists(name, lambda x: F.size(x["found"]) > 0)
    rows = rows.withColumn("text", F.when(hit, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)


def _case(tree) -> str:
    if not isinstance(tree, tuple):
        return f"({tree!r}e0)" if "e" not in repr(tree) else f"({tree!r})"
    return f"CASE WHEN {M.FEATURES[tree[0]]} <= {tree[1]} THEN {_case(tree[2])} ELSE {_case(tree[3])} END"


def _placed(source: str, names: str, text: str, pattern: str, key: str, kind: str = "''") -> str:
    """SQL: a pattern's matches (m), what stands before (g), number i and places s, e, for each row of ``source``."""
    found, between = f"regexp_extract_all({text}, '{pattern}')", f"regexp_split_to_array({text}, '{pattern}')"
    return (
        f"SELECT *, e - length(m) AS s FROM (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY {key} ORDER BY i))::BIGINT AS e FROM ("
        f"SELECT {names}, {kind} AS kind, unnest(found) AS m, unnest(between[1:len(found)]) AS g, unnest(range(len(found))) AS i "
        f"FROM (SELECT *, {found} AS found, {between} AS between FROM {source}) WHERE len(found) > 0))"
    )


def oracle() -> str:
    """DuckDB SQL for :func:`pii_scan`: the same rules with joins and windows in place of arrays."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = (  # of column number
        "list_sum(list_transform(range(1, length(number) + 1), lambda i: CASE WHEN i % 2 = 0 AND substr(reverse(number), i, 1)::INT > 4 "
        "THEN substr(reverse(number), i, 1)::INT * 2 - 9 WHEN i % 2 = 0 THEN substr(reverse(number), i, 1)::INT * 2 ELSE substr(reverse(number), i, 1)::INT END))"
    )
    count = lambda text, sign: f"length({text}) - length(replace({text}, '{sign}', ''))"
    flag = lambda text, pattern: f"regexp_matches({text}, '{pattern}')::INT"
    small = lambda text: f"translate({text}, '{UPPER}', '{LOWER}')"
    near = f"{small(f'right(CASE WHEN i = 0 THEN before || g ELSE g END, {CONTEXT})')} AS context"
    words = {name: flag("context", p) for name, p in M.CONTEXT_WORDS.items()} | {"glued": flag("context", M.GLUED)}
    columns = lambda known: ", ".join(f"({(known | words).get(name, '0')})::INT AS {name}" for name in M.FEATURES)
    number = columns({
        "digits": "length(number)", "groups": "n", "first": "length(m)", "last": "length(ms[n])", "most": "list_max(list_transform(ms[1:n], lambda x: length(x)))",
        "hyphens": count("signs", "-"), "dots": count("signs", "."), "spaces": count("signs", " "), "bracket": flag("context || signs", M.BRACKET),
        "plus": flag("context", M.PLUS), "luhn": f"CASE WHEN length(number) >= 13 THEN ({luhn_sum} % 10 = 0)::INT ELSE 0 END", "zero": flag("number", "^0"),
        "year": f"CASE WHEN length(m) = 4 THEN {flag('m', '^(19|20)')} ELSE 0 END", "inner": f"CASE WHEN i > 0 THEN {flag('g', M.BETWEEN)} ELSE 0 END",
        "more": f"CASE WHEN gs[n + 1] IS NOT NULL THEN {flag('rest', M.BETWEEN)} ELSE 0 END", "tail": flag("rest", M.TAIL),
    })
    token = columns({
        "token": "1", "length": "least(length(m), 99)", "numbers": f"least(length({digits}), 99)", "hex": flag("m", "^([0-9a-f]+|[0-9A-F]+)$"),
        "turns": "least(len(regexp_extract_all(m, '[0-9]+')), 99)", "hyphens": count("m", "-"), "mixed": f"{flag('m', '[a-z]')} + {flag('m', '[A-Z]')}", "prefix": flag("m", M.PREFIX),
    })
    spelled = columns({
        "spelled": "1", "bracket": flag("m", r"\("), "length": "least(length(m), 99)", "first": "least(length(regexp_extract(m, '^[^ (]*')), 99)",
        "last": "least(length(regexp_extract(m, '[A-Za-z0-9-]*$')), 99)", "stop": flag(small("m"), M.STOP),
    })
    scores = ", ".join(f"{_case(-threshold)} + {' + '.join(map(_case, trees))} AS p_{kind}" for kind, (trees, threshold) in M.model().items())
    top = f"greatest({', '.join(f'p_{k}' for k in M.KINDS)})"
    chosen = " ".join(f"WHEN p_{k} = {top} THEN '{k}'" for k in M.KINDS)
    leads = lambda c, n: ", ".join([c] + [f"lead({c}, {j}) OVER w" for j in range(1, n)])
    base = " UNION ALL ".join(f"({_placed('reg', 'rid, ri, org', 'region', p, 'rid, ri', repr(k))})" for k, p in M.BASE.items())
    shown = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s, e)"
    keys = "rid, ri, org, before, region"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
reg AS (SELECT rid, i AS ri, s AS org, m AS region, right(g, {CONTEXT}) AS before FROM ({_placed("d", "rid", "text", M.REGION, "rid")})),
base AS (SELECT rid, ri, org, kind, s, e FROM (SELECT *, {digits} AS number FROM ({base})) WHERE CASE kind WHEN 'email' THEN true
  WHEN 'phone' THEN length(number) BETWEEN 9 AND 15 WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: x::DOUBLE > 255)) = 0
  ELSE length(number) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0 END),
grp AS ({_placed("reg", keys, "region", "[0-9]+", "rid, ri")}),
runs AS (SELECT *, unnest(range(1, {M.MOST_GROUPS + 1})) AS n FROM (
  SELECT *, lag(m) OVER w AS pm, [{leads("m", M.MOST_GROUPS)}] AS ms, [{leads("g", M.MOST_GROUPS + 1)}] AS gs, [{leads("e", M.MOST_GROUPS)}] AS es
  FROM grp WINDOW w AS (PARTITION BY rid, ri ORDER BY i))),
numbers AS (SELECT *, array_to_string(ms[1:n], '') AS number, array_to_string(gs[2:n], '') AS signs, es[n] AS stop,
  coalesce(gs[n + 1], substr(region, es[n] + 1, 3)) AS rest, {small(f"right(CASE WHEN i = 0 THEN before || g ELSE pm || g END, {CONTEXT})")} AS context
  FROM runs WHERE ms[n] IS NOT NULL AND len(list_filter(gs[2:n], lambda x: NOT regexp_matches(x, '{M.BETWEEN}'))) = 0),
pool AS (
  SELECT rid, ri, org, s, stop AS e, {number} FROM numbers WHERE length(number) BETWEEN {M.LEAST_DIGITS} AND {M.MOST_DIGITS} UNION ALL
  SELECT rid, ri, org, s, e, {token} FROM (SELECT *, {near} FROM ({_placed("reg", keys, "region", M.TOKEN, "rid, ri")}))
    WHERE length(m) >= {M.LEAST_TOKEN} AND regexp_matches(m, '[0-9]') UNION ALL
  SELECT rid, ri, org, s, e, {spelled} FROM (SELECT *, {near} FROM ({_placed("reg", keys, "region", M.SPELLED, "rid, ri")}))),
outside AS (SELECT pool.* FROM pool ANTI JOIN base b ON b.rid = pool.rid AND b.ri = pool.ri AND b.s <= pool.s AND b.e >= pool.e),
free AS (SELECT rid, ri, org, s, e, {scores} FROM outside),
chosen AS (SELECT rid, ri, org, s, e, {top} AS p, CASE {chosen} END AS kind FROM free WHERE {top} > 0),
marked AS (SELECT *, max(e) OVER (PARTITION BY rid, ri ORDER BY s, e, p, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chosen),
islands AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY rid, ri ORDER BY s, e, p, kind ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (SELECT rid, org, kind, s, e FROM base UNION ALL
  SELECT rid, org, (list(kind ORDER BY p DESC, s, e))[1], min(s), max(e) FROM islands GROUP BY rid, ri, org, island),
r AS (SELECT rid, kind, org + s AS s, org + e AS e, list_position([{", ".join(map(repr, KINDS))}], kind) AS k FROM spans)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (r.kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce({shown} FILTER (r.k <= {len(BASE)}), '')) AS base_sha256, coalesce({shown}, '') AS spans
FROM d LEFT JOIN r ON d.rid = r.rid GROUP BY d.rid, d.doc_id
"""
