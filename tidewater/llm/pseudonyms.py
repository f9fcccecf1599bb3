"""Format-preserving pseudonyms, in Spark's own functions.

A value is cut into elements, each a number below its own radix: digits, letters
of one case, hexadecimal digits, address octets, parts of a day count. A Feistel
network over the two halves of the elements adds a keyed hash of one half to the
other, element by element, round after round. That permutes the values of one
format, so equal values get equal pseudonyms everywhere and different values
different ones, and the same rounds run backwards give the value back.

Kinds: card numbers (13-19 digits, Luhn-valid before and after, first digit
kept), North American phone numbers, IPv4 addresses (first octet 1-223), US
social security numbers, dates (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy within 72,900
days from 1900-01-01), local parts of e-mail addresses, access keys, passwords and
hexadecimal secrets. What fails its validation stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: 72,900 = 270 * 270 days from this one.
EPOCH, DAY_RADIX = "1900-01-01", 270

KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "access": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": r"(?<=password=)[A-Za-z0-9]{8,64}+(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])",
    "ymd": r"(?<![0-9])[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}(?![0-9])",
    "dmy": r"(?<![0-9])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])",
}
# A whole run of digit groups, up to a value of another kind that goes on after it; which groups are cards is tried later.
KINDS["card"] = rf"(?<![0-9])[0-9](?:[0-9]|[ -](?!{KINDS['email']}|{KINDS['hex']}|{KINDS['dmy']}|{KINDS['ip']}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}(?![0-9])|(?=[0-9 -]{{3,8}}\.){KINDS['phone']})[0-9]){{12,}}+"
#: The back reference counts groups in the whole pattern; this is the only group there is.
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
OTHERS = "|".join(f"(?:{p})" for kind, p in KINDS.items() if kind != "card")
#: Sizes of digit groups as cards are printed; such a card goes before a span that is valid but begins earlier.
PRINTED = "^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
CARD_DIGITS = 13, 19


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _feistel(values: Column, radices: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """Elements after all rounds; `back` undoes them."""
    half = F.floor(F.size(values) / 2).cast("int")
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def one(state, i):
        first = i % 2 == 0
        other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half))

        def add(x, j):
            stream = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.floor(j / 32).cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
            step = F.conv(F.substring(stream, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("long") % F.get(radices, j)
            moved = F.pmod(x - step, F.get(radices, j)) if back else (x + step) % F.get(radices, j)
            return F.when((j < half) == first, moved).otherwise(x)

        return F.transform(state, add)

    return F.aggregate(order, values, one)


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _luhn(digits: Column) -> Column:
    """The sum that is 0 modulo 10 for a valid number; digits as array of long."""
    size = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((size - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, d: a + d) % 10


def _digits(text: Column) -> Column:
    return F.filter(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c != "").cast("array<long>")


def _rewritten(text: Column, cells: Column, key: str, tweak: Column, back: bool) -> Column:
    """text with each character's element permuted. cells: array of (base, radix), radix 0 for characters that stay."""
    code = F.transform(_chars(text), lambda c: F.ascii(c).cast("long"))

    def build(cell, code):
        values = F.filter(F.transform(code, lambda c, j: F.when(F.get(cell, j)["radix"] > 0, c - F.get(cell, j)["base"])), lambda x: x.isNotNull())
        radices = F.transform(F.filter(cell, lambda c: c["radix"] > 0), lambda c: c["radix"])
        place = lambda j: F.size(F.filter(F.slice(cell, F.lit(1), j), lambda c: c["radix"] > 0))
        return _let(_feistel(values, radices, tweak, key, back), lambda new: F.array_join(F.transform(_chars(text), lambda c, j: F.when(F.get(cell, j)["radix"] > 0, F.char(F.get(cell, j)["base"] + F.get(new, place(j)))).otherwise(c)), ""))

    return _let(cells, lambda cell: _let(code, lambda c: build(cell, c)))


def _cell(base, radix) -> Column:
    return F.struct(F.lit(base).cast("long").alias("base"), F.lit(radix).cast("long").alias("radix"))


def _by_class(text: Column, hexadecimal: bool = False) -> Column:
    """Cells for letters and digits by their class; hexadecimal digits keep to 0-9 and a-f by class."""
    return F.transform(_chars(text), lambda c: F.when(c.rlike("^[0-9]$"), _cell(48, 10)).when(c.rlike("^[a-f]$" if hexadecimal else "^[a-z]$"), _cell(97, 6 if hexadecimal else 26)).when(c.rlike("^[A-Z]$"), _cell(65, 26)).otherwise(_cell(0, 0)))


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")


def _whole(m: Column, kind: str, key: str, back: bool, hexadecimal: bool = False) -> Column:
    return _rewritten(m, _by_class(m, hexadecimal), key, F.concat(F.lit(kind), _shape(m)), back)


def _email(m: Column, key: str, back: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    none = F.length(F.regexp_replace(local, "[^A-Za-z0-9]", "")) == 0
    return F.when(none, m).otherwise(F.concat(_whole(local, "email", key, back), F.lit("@"), F.substring_index(m, "@", -1)))


def _access(m: Column, key: str, back: bool) -> Column:
    return F.concat(F.lit("AKIA"), _whole(F.substring(m, 5, 16), "access", key, back))


def _phone(m: Column, key: str, back: bool) -> Column:
    """The last ten digits; area and exchange codes start with 2-9."""

    def cells(digits):
        many = F.length(F.regexp_replace(m, "[^0-9]", ""))
        seen = lambda j: F.length(F.regexp_replace(F.substring(m, F.lit(1), j), "[^0-9]", "")) - (many - 10)
        return F.transform(digits, lambda c, j: F.when(~c.rlike("^[0-9]$") | (seen(j) < 0), _cell(0, 0)).when(seen(j).isin(0, 3), _cell(50, 8)).otherwise(_cell(48, 10)))

    return _rewritten(m, cells(_chars(m)), key, F.lit("phone"), back)


def _card(m: Column, key: str, back: bool) -> Column:
    def rewritten(digits):
        inner = F.slice(digits, F.lit(2), F.size(digits) - 2)
        new = _feistel(inner, F.transform(inner, lambda _: F.lit(10).cast("long")), F.concat(F.lit("card"), F.get(digits, 0).cast("string"), F.size(digits).cast("string")), key, back)
        body = F.concat(F.slice(digits, 1, 1), new)
        full = _let(body, lambda b: F.concat(b, F.array((10 - _luhn(F.concat(b, F.array(F.lit(0).cast("long"))))) % 10)))
        place = lambda j: F.length(F.regexp_replace(F.substring(m, F.lit(1), j), "[^0-9]", ""))
        return F.when(_luhn(digits) == 0, _let(full, lambda f: F.array_join(F.transform(_chars(m), lambda c, j: F.when(c.rlike("^[0-9]$"), F.get(f, place(j)).cast("string")).otherwise(c)), ""))).otherwise(m)

    return _let(_digits(m), rewritten)


def _numbers(values: Column, radices: list[int], kind: str, key: str, back: bool) -> Column:
    return _feistel(values, F.array(*[F.lit(r).cast("long") for r in radices]), F.lit(kind), key, back)


def _ip(m: Column, key: str, back: bool) -> Column:
    def rewritten(o):
        valid = F.forall(o, lambda x: x <= 255) & (F.get(o, 0) >= 1) & (F.get(o, 0) <= 223) & ~m.rlike(r"(^|\.)0[0-9]")
        inner = F.transform(o, lambda x, j: F.when(j == 0, x - 1).otherwise(x))
        new = _numbers(inner, [223, 256, 256, 256], "ip", key, back)
        return F.when(valid, F.array_join(F.transform(new, lambda x, j: F.when(j == 0, x + 1).otherwise(x).cast("string")), ".")).otherwise(m)

    return _let(F.split(m, r"\.").cast("array<long>"), rewritten)


def _ssn(m: Column, key: str, back: bool) -> Column:
    def rewritten(p):
        area, group, serial = (F.get(p, k) for k in range(3))
        valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
        inner = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        new = _numbers(inner, [898, 99, 9999], "ssn", key, back)
        return F.when(valid, _let(new, lambda n: F.format_string("%03d-%02d-%04d", F.when(F.get(n, 0) >= 665, F.get(n, 0) + 2).otherwise(F.get(n, 0) + 1), F.get(n, 1) + 1, F.get(n, 2) + 1))).otherwise(m)

    return _let(F.split(m, "-").cast("array<long>"), rewritten)


def _date(m: Column, key: str, back: bool, form: Column | str) -> Column:
    """One permutation for all forms of a date, so a date stays linked however it is written."""

    def rewritten(days):
        inner = F.array(F.floor(days / DAY_RADIX).cast("long"), (days % DAY_RADIX).cast("long"))
        new = _numbers(inner, [DAY_RADIX, DAY_RADIX], "date", key, back)
        moved = _let(new, lambda n: F.date_add(F.lit(EPOCH).cast("date"), (F.get(n, 0) * DAY_RADIX + F.get(n, 1)).cast("int")))
        return F.when((days >= 0) & (days < DAY_RADIX**2), F.date_format(moved, form)).otherwise(m)

    iso = F.regexp_replace(m, r"^(\d\d)\.(\d\d)\.(\d{4})$", "$3-$2-$1") if form == "dd.MM.yyyy" else F.translate(m, "/", "-")
    return _let(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(EPOCH).cast("date")).cast("long"), rewritten)


def _cards(groups: Column) -> Column:
    """(begin, size) of the cards in a run of digit groups with their separators, in order; none overlap."""
    return _let(F.transform(groups, lambda g: F.length(F.regexp_replace(g, "[^0-9]", ""))), lambda lengths: _cards_among(groups, lengths))


def _cards_among(groups: Column, lengths: Column) -> Column:
    least, most = CARD_DIGITS
    # Element by element: a slice copies the whole run each time.
    span = lambda i, n: F.array_join(F.transform(F.sequence(i, i + n - 1), lambda j: F.get(groups, j)), "")

    def sizes(i):
        """Numbers of groups from group i on that are a valid card, longest first."""

        def valid(n):
            many = F.aggregate(F.sequence(i, i + n - 1), F.lit(0), lambda sum_, j: sum_ + F.get(lengths, j))
            return many.between(least, most) & (_luhn(_digits(span(i, n))) == 0)

        return F.filter(F.sequence(F.least(F.lit(most), F.size(groups) - i), F.lit(1), F.lit(-1)), valid)

    def printed(i, n):
        return F.rlike(F.regexp_replace(span(i, n), "^[ -]", ""), F.lit(PRINTED))

    def take(state, i):
        at = lambda j: F.get(state["all"], j)
        # The shortest, as three more digits are more often a check value than a card's end.
        own = F.array_min(F.filter(at(i), lambda n: printed(i, n)))
        # Not one that reaches into a printed card beginning later.
        free = F.get(F.filter(at(i), lambda n: ~F.exists(F.sequence(i, i + n - 1), lambda j: (j > i) & F.exists(at(j), lambda k: printed(j, k)))), 0)
        taken = lambda chosen: F.struct(state["all"].alias("all"), (i + chosen).alias("upto"), F.concat(state["taken"], F.array(F.struct(i.alias("begin"), chosen.alias("size")))).alias("taken"))
        found = _let(F.coalesce(own, free), lambda chosen: F.when(chosen.isNotNull(), taken(chosen)).otherwise(state))
        return F.when((i >= state["upto"]) & (F.size(at(i)) > 0), found).otherwise(state)

    places = F.sequence(F.lit(0), F.size(groups) - 1)
    start = F.struct(F.transform(places, sizes).alias("all"), F.lit(0).alias("upto"), F.array().cast("array<struct<begin:int,size:int>>").alias("taken"))
    return F.aggregate(places, start, take, lambda s: s["taken"])


def _piece(text: Column, value: Column | bool) -> Column:
    return F.struct(text.alias("text"), F.lit(value).alias("value"))


def _run(m: Column) -> Column:
    """(text, value) of the pieces of a run of digit groups: cards, and between them values of other kinds and what stays."""

    def pieces(groups):
        text = lambda begin, end: F.when(end > begin, F.array_join(F.transform(F.sequence(begin, end - 1), lambda j: F.get(groups, j)), "")).otherwise("")

        def around(cards):
            after = lambda i: F.coalesce(F.get(cards, i)["begin"] + F.get(cards, i)["size"], F.lit(0))

            def one(card, i):
                value = text(card["begin"], card["begin"] + card["size"])
                before = F.concat(text(after(i - 1), card["begin"]), F.regexp_extract(value, "^[ -]?", 0))
                return F.array(F.struct(before.alias("before"), F.regexp_replace(value, "^[ -]", "").alias("card")))

            rest = F.struct(text(after(F.size(cards) - 1), F.size(groups)).alias("before"), F.lit("").alias("card"))
            return F.concat(F.flatten(F.transform(cards, one)), F.array(rest))

        return _let(_cards(groups), around)

    def others(x):
        both = F.arrays_zip(F.split(x["before"], OTHERS, -1).alias("stays"), F.regexp_extract_all(x["before"], F.lit(OTHERS), F.lit(0)).alias("found"))
        cut = F.flatten(F.transform(both, lambda y: F.array(_piece(y["stays"], False), _piece(F.coalesce(y["found"], F.lit("")), True))))
        return F.concat(cut, F.array(_piece(x["card"], True)))

    # Each group holds the separator before it.
    return F.flatten(F.transform(_let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), pieces), others))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one matched value; `back` gives the value of a pseudonym."""
    is_a = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    return (
        F.when(m.contains("@"), _email(m, key, back))
        .when(is_a("access"), _access(m, key, back))
        .when(is_a("hex"), _whole(m, "hex", key, back, True))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(m, key, back, "yyyy-MM-dd"))
        .when(m.rlike("^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), _date(m, key, back, "yyyy/MM/dd"))
        .when(is_a("dmy"), _date(m, key, back, "dd.MM.yyyy"))
        .when(is_a("ip"), _ip(m, key, back))
        .when(is_a("ssn"), _ssn(m, key, back))
        .when(is_a("phone"), _phone(m, key, back))
        .when(is_a("card"), _card(m, key, back))
        .otherwise(F.when(m.rlike("^[A-Za-z0-9]{8,64}$"), _whole(m, "password", key, back)).otherwise(m))
    )


def pseudonymised(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """docs with the values in text replaced and n_replaced, the number of values that changed.

    Whoever has the key can go back, so it is for the caller to choose and keep.

    Values are found anew in each text, and none by its neighbours, so repeated
    rows come out alike. A null text stays null with 0 values. Columns of docs stay
    as they are (a column n_replaced is replaced); an empty table gives no rows.
    """
    found, new, parts = "__found", "__new", "__parts"
    some = F.coalesce(F.col("text").rlike("[0-9@]|password=|AKIA|[a-f]{32}"), F.lit(False))
    none = F.array().cast("array<string>")
    out = docs.withColumn(found, F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none))
    is_run = lambda m: m.rlike(f"^{KINDS['card']}$") & ~m.rlike(f"^{KINDS['hex']}$")
    cut = F.transform(found, lambda m: F.when(is_run(m), _run(m)).otherwise(F.array(_piece(m, True))))
    each = F.transform(cut, lambda run: F.transform(run, lambda x: F.struct(x["text"].alias("old"), F.when(x["value"], pseudonym(x["text"], key, back)).otherwise(x["text"]).alias("new"))))
    out = out.withColumn(new, F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<array<struct<old:string,new:string>>>")))
    out = out.withColumn(parts, F.when(F.size(found) > 0, F.split("text", ANY, -1)).otherwise(none))
    # Both arrays are bound once, whichever columns are read; the last part has no value behind it.
    joined = F.array_join(F.zip_with(parts, new, lambda p, run: F.concat(p, F.coalesce(F.array_join(F.transform(run, lambda x: x["new"]), ""), F.lit("")))), "")
    changed = F.size(F.filter(F.flatten(new), lambda x: x["old"] != x["new"]))
    return out.withColumn("n_replaced", changed.cast("long")).withColumn("text", F.when(F.size(found) > 0, joined).otherwise(F.col("text"))).drop(found, new, parts)
