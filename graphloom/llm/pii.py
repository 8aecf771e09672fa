"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

A value that passes its validation (a Luhn check, a possible date, octets up to 255, an IBAN's mod 97,
a telephone number's plan) is replaced by another value of the same format: the same length, the same
separators, the same kind of character at each place, and valid again. A keyed Feistel network over
the value's digits (or letters, or the day's number) permutes the values of a format, so equal values
stay equal in every document and different ones stay different, and nothing has to be looked up: the
operator is one projection without a shuffle.

The key is the caller's: whoever has it can undo the network. Queries take it from the session's setting
spark.graphloom.pii.secret; where none is set, each driver process draws a key of its own and forgets it,
so pseudonyms link within what that process writes and nobody can undo them.

Defined results: a null text stays null, an empty text stays empty, all other columns pass unchanged,
repeated rows get the same pseudonyms, an empty table gives an empty one. Digits that fail validation
are no personal number and stay. Of a run of digits and capitals, each part from the start of one group
of characters to the end of one is validated; the longest valid parts that don't overlap are replaced,
IBANs, dates, addresses and social security numbers before the others. Runs of more than BLOCK characters
are worked through block by block, from left to right, a part belonging to the block it starts in: no valid
value is passed over unless it overlaps a replaced one, and work grows linearly with a run. The local part
of an address is at most its last 64 characters, its domain at most 126 labels.
"""

from __future__ import annotations

import secrets
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

SETTING = "spark.graphloom.pii.secret"
ROUNDS = 8
#: Characters of a run that are looked at together.
BLOCK = 256
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 x 4,297, so that a network over the two factors permutes exactly these days.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 17, 4297
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: Candidates, the more specific first; a candidate counts once it is validated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-])(?!\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,6}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
#: What is looked at as a whole: these kinds run on over the digits after them, as another value may follow.
_ON = r"[\d ./-]*+"
RUNS = PATTERNS | {
    "iban": PATTERNS["iban"] + _ON,
    "phone": "|".join(f"(?:{p})" for p in (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}[ .-]?\d{2,4}" + _ON, *PATTERNS["phone"].split("|")[1:])),
    "card": r"(?<![\d-])(?=\d(?:[ -]?\d){12})\d" + _ON,
}
ANY = "|".join(f"(?:{p})" for p in RUNS.values())
#: No value but an address is longer: 34 characters of an IBAN with a blank before every fourth, 19 digits of a card with 18 separators.
LONGEST = 44
#: Texts without one of these have no candidate at all.
HINT = r"\d|@"


def _keyed(key: str, kind: str, size: Column, i: Column, half: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256 of the format, the round and the other half."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), i.cast("string"), half.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, high_size: Column, low_size: Column, key: str, kind: str) -> Column:
    """A permutation of the pairs (high, low) below (high_size, low_size): in turn, each half moves by a keyed function of the other."""
    size = F.concat_ws(",", high_size.cast("string"), low_size.cast("string"))

    def turn(s: Column, i: Column) -> Column:
        new_high = F.when(i % 2 == 0, F.pmod(s["h"] + _keyed(key, kind, size, i, s["l"]), high_size)).otherwise(s["h"])
        new_low = F.when(i % 2 == 1, F.pmod(s["l"] + _keyed(key, kind, size, i, s["h"]), low_size)).otherwise(s["l"])
        return F.struct(new_high.alias("h"), new_low.alias("l"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(high.cast("long").alias("h"), low.cast("long").alias("l")), turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (1 to 34), by a network over its two halves. A single digit moves by a keyed shift."""

    def of(d: Column) -> Column:
        n = F.length(d)
        left, right = (n / 2).cast("int"), n - (n / 2).cast("int")
        size = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = feistel(F.coalesce(F.substr(d, F.lit(1), left).try_cast("long"), F.lit(0).cast("long")), F.substr(d, left + 1, right).cast("long"), size(left), size(right), key, kind)
        return F.when(n == 0, d).otherwise(let(pair, lambda p: F.concat(F.when(left > 0, F.lpad(p["h"].cast("string"), left, "0")).otherwise(F.lit("")), F.lpad(p["l"].cast("string"), right, "0"))))

    return let(digits, of)


def permuted_letters(value: Column, key: str) -> Column:
    """Each letter and digit becomes another of its kind: its number is shifted by a keyed function of all other places' shape, chained over two passes."""

    def one_pass(chars: Column, tag: str) -> Column:
        """A Feistel-like pass: the characters of even places move by a function of those at odd places, or the other way."""
        even = F.array_join(F.filter(chars, lambda c, i: i % 2 == (0 if tag in "02" else 1)), "")
        return let(even, lambda fixed: F.transform(chars, lambda c, i: F.when(i % 2 == (0 if tag in "02" else 1), c).otherwise(shifted(c, F.pmod(_keyed(key, "letters" + tag, F.size(chars), i, fixed), F.lit(2340).cast("long"))))))

    def shifted(c: Column, by: Column) -> Column:
        out = c
        for alphabet in (LOWER, UPPER, DIGITS):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substr(F.lit(alphabet), (F.pmod(at - 1 + by, F.lit(len(alphabet)).cast("long")) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    chars = F.split(value, "")
    return let(chars, lambda c: let(one_pass(c, "0"), lambda c1: let(one_pass(c1, "1"), lambda c2: let(one_pass(c2, "2"), lambda c3: F.array_join(one_pass(c3, "3"), "")))))


def refilled(shape: Column, digits: Column) -> Column:
    """The shape's digits replaced, in order, by the given ones; separators stay."""
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["t"], F.substr(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def check_digit(body: Column) -> Column:
    """The Luhn digit that makes body + digit valid."""
    total = F.aggregate(F.reverse(F.split(body, "")), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), lambda s, c: let(c.cast("int") * F.when(s["i"] % 2 == 0, 2).otherwise(1), lambda v: F.struct((s["s"] + F.when(v > 9, v - 9).otherwise(v)).alias("s"), (s["i"] + 1).alias("i"))), lambda s: s["s"])
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def new_card(x: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        moved = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return F.when(F.length(d) < 13, x).when(check_digit(body) != F.right(d, F.lit(1)), x).otherwise(let(moved, lambda m: refilled(x, F.concat(m, check_digit(m)))))

    return let(only_digits(x), of)


def new_phone(x: Column, key: str) -> Column:
    """The country code stays; the subscriber's digits are permuted. 7 to 15 digits in all, else it is no telephone number."""

    def of(d: Column) -> Column:
        code = F.when(x.startswith("+"), F.length(F.regexp_extract(x, r"^\+(\d{1,3}?)(?=[ .(-]|\d{9,})", 1))).otherwise(F.lit(0))
        return F.when(~F.length(d).between(7, 15), x).otherwise(let(code, lambda k: refilled(x, F.concat(F.substr(d, F.lit(1), k), permuted_digits(F.substr(d, k + 1, F.length(d) - k), key, "phone")))))

    return let(only_digits(x), of)


def new_ssn(x: Column, key: str) -> Column:
    valid = ~x.rlike(r"^(000|666|9\d\d)|-00-|-0000$")
    return F.when(valid, refilled(x, permuted_digits(only_digits(x), key, "ssn"))).otherwise(x)


def new_ip(x: Column, key: str) -> Column:
    """Two pairs of octets are the halves. An octet moves among those of as many digits: 10, 90 or 156 of them."""

    def of(o: Column) -> Column:
        first = lambda v: F.when(v < 10, 0).when(v < 100, 10).otherwise(100).cast("long")
        size = lambda v: F.when(v < 10, 10).when(v < 100, 90).otherwise(156).cast("long")
        half = lambda i: (o[i] - first(o[i])) * size(o[i + 1]) + o[i + 1] - first(o[i + 1])
        pair = feistel(half(0), half(2), size(o[0]) * size(o[1]), size(o[2]) * size(o[3]), key, "ip")
        octets = lambda h, i: [first(o[i]) + F.floor(h / size(o[i + 1])), first(o[i + 1]) + h % size(o[i + 1])]
        return let(pair, lambda p: F.concat_ws(".", *(v.cast("string") for v in octets(p["h"], 0) + octets(p["l"], 2))))

    valid = lambda o: ~F.exists(o, lambda v: v > 255) & ~x.rlike(r"(^|\.)0\d")
    return let(F.transform(F.split(x, r"\."), lambda c: c.cast("long")), lambda o: F.when(valid(o), of(o)).otherwise(x))


def new_date(x: Column, key: str) -> Column:
    """The day's number within 1900 to 2099 is permuted. Day and month in their written order; with slashes month first, unless that is no date."""

    def moved(day: Column) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        pair = feistel(F.floor(n / DAYS_LOW), n % DAYS_LOW, F.lit(DAYS_HIGH).cast("long"), F.lit(DAYS_LOW).cast("long"), key, "date")
        return F.date_add(F.lit(FIRST_DAY).cast("date"), let(pair, lambda p: (p["h"] * DAYS_LOW + p["l"]).cast("int")))

    def written(form: str) -> Column:
        day = F.to_date(F.try_to_timestamp(x, F.lit(form)))
        return let(day, lambda d: F.when(d.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.date_format(moved(d), form)))

    known = F.when(x.rlike(r"^\d{4}-"), written("yyyy-MM-dd")).when(x.rlike(r"^\d{4}/"), written("yyyy/MM/dd")).when(x.rlike(r"^..\."), written("dd.MM.yyyy"))
    return F.coalesce(known.otherwise(F.coalesce(written("MM/dd/yyyy"), written("dd/MM/yyyy"))), x)


def new_iban(x: Column, key: str) -> Column:
    """Country and account shape stay, the account's digits are permuted, the two check digits are computed anew. mod 97 in blocks of digits."""

    def mod97(chars: Column) -> Column:
        return F.aggregate(F.split(chars, ""), F.lit(0).cast("long"), lambda s, c: F.when(c.between("0", "9"), F.pmod(s * 10 + F.try_to_number(c, F.lit("9")).cast("long"), F.lit(97).cast("long"))).otherwise(F.pmod(s * 100 + (F.ascii(c) - 55).cast("long"), F.lit(97).cast("long"))))

    def of(v: Column) -> Column:
        country, body = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5), F.length(v) - 4)
        valid = F.length(v).between(15, 34) & (mod97(F.concat(body, country, F.substr(v, F.lit(3), F.lit(2)))) == 1)
        new_body = refilled(body, permuted_digits(only_digits(body), key, "iban"))
        check = lambda b: F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        return F.when(valid, let(new_body, lambda b: refilled(x, F.concat(check(b), only_digits(b))))).otherwise(x)

    return let(F.regexp_replace(x, " ", ""), of)


def new_email(x: Column, key: str) -> Column:
    """The part before the @ is permuted, letter for letter and digit for digit; the domain stays."""
    return F.concat(permuted_letters(F.substring_index(x, "@", 1), key), F.lit("@"), F.substring_index(x, "@", -1))


@cache
def _own_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key that the session names, else this process's own."""
    return spark.conf.get(SETTING, None) or _own_key()


def pseudonym(x: Column, alone: Column, key: str) -> Column:
    """The pseudonym of one candidate, by its kind. Alone: no separator and digit are beside it; dates, addresses and short numbers must be."""
    whole = lambda kind: x.rlike(f"^(?:{PATTERNS[kind]})$")
    cases = F.when(whole("iban"), new_iban(x, key))
    for kind, new in (("date", new_date), ("ip", new_ip), ("ssn", new_ssn)):
        cases = cases.when(alone & whole(kind), new(x, key))
    return cases.when((alone | x.startswith("+")) & whole("phone"), new_phone(x, key)).when(whole("card"), new_card(x, key)).otherwise(x)


def valid_parts(x: Column, low: Column, high: Column, key: str) -> Column:
    """array of struct(i, j, new): the first and last place and the pseudonym of the values that start at low to high, in their order."""

    def windows(c: Column) -> Column:
        """All parts between the starts and ends of groups."""
        word = lambda k: F.coalesce(F.get(c, k - 1).rlike("[A-Za-z0-9]"), F.lit(False))
        places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (word(i) | F.get(c, i - 1).isin("+", "(")) & ~word(i - 1) & ~F.coalesce(F.get(c, i - 2) == "+", F.lit(False)))
        ends = lambda i: F.filter(F.sequence(i, F.least(i + LONGEST - 1, F.size(c))), lambda j: (j >= i + 6) & word(j) & ~word(j + 1))
        return F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def made(w: Column) -> Column:
        part = F.substr(x, w["i"], w["j"] - w["i"] + 1)
        before, after = F.substr(x, F.greatest(w["i"] - 1, F.lit(1)), F.lit(1)), F.substr(x, w["j"] + 1, F.lit(2))
        alone = ((w["i"] == 1) | before.isin(" ", ")")) & ~after.rlike(r"^(?:[/-]|\.\d)")
        return let(part, lambda v: F.struct(w["i"].alias("i"), w["j"].alias("j"), v.alias("old"), pseudonym(v, alone, key).alias("new")))

    #: One in ten parts passes a card's check by chance, so kinds with a stricter form go before cards and telephone numbers.
    sure = lambda v: v.rlike("^(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("iban", "date", "ip", "ssn")) + ")$")

    def chosen(valid: Column) -> Column:
        order = F.array_sort(F.transform(valid, lambda v: F.struct((~sure(v["old"])).alias("other"), (v["i"] - v["j"]).alias("n"), v["i"].alias("i"), v["j"].alias("j"), v["new"].alias("new"))))
        none = F.slice(F.transform(order, lambda v: F.struct(v["i"].alias("i"), v["j"].alias("j"), v["new"].alias("new"))), 1, 0)
        free = lambda got, v: ~F.exists(got, lambda g: (g["i"] <= v["j"]) & (v["i"] <= g["j"]))
        return F.array_sort(F.aggregate(order, none, lambda got, v: F.when(free(got, v), F.concat(got, F.array(F.struct(v["i"].alias("i"), v["j"].alias("j"), v["new"].alias("new"))))).otherwise(got)))

    return let(F.filter(F.transform(let(F.split(x, ""), windows), made), lambda v: v["new"] != v["old"]), chosen)


def renewed(x: Column, key: str) -> Column:
    """struct(t, n) of a run: its text with the values' pseudonyms, and how many it had. A block sees two characters before it and as many after it as a value that starts in it may need."""

    def step(blocks: Column):
        def of(s: Column, k: Column) -> Column:
            before, own = F.coalesce(F.right(F.get(blocks, k - 1), F.lit(2)), F.lit("")), F.get(blocks, k)
            seen = F.concat(before, own, F.coalesce(F.left(F.get(blocks, k + 1), F.lit(LONGEST + 2)), F.lit("")))
            return let(F.struct(seen.alias("x"), F.length(before).alias("off"), (F.length(before) + F.length(own)).alias("end")), lambda b: written(s, b))

        return of

    def written(s: Column, b: Column) -> Column:
        put = lambda w, v: F.struct(F.concat(w["t"], F.substr(b["x"], w["at"], v["i"] - w["at"]), v["new"]).alias("t"), (v["j"] + 1).alias("at"))
        parts = valid_parts(b["x"], b["off"] + s["skip"] + 1, b["end"], key)
        rest = lambda w: F.when(w["at"] <= b["end"], F.substr(b["x"], w["at"], b["end"] - w["at"] + 1)).otherwise(F.lit(""))
        done = lambda p: F.aggregate(p, F.struct(F.lit("").alias("t"), (b["off"] + s["skip"] + 1).alias("at")), put, lambda w: F.struct(F.concat(w["t"], rest(w)).alias("t"), F.greatest(w["at"] - b["end"] - 1, F.lit(0)).alias("skip"), F.size(p).alias("n")))
        return let(parts, lambda p: let(done(p), lambda d: F.struct(F.concat(s["t"], F.array(d["t"])).alias("t"), d["skip"].alias("skip"), (s["n"] + d["n"]).alias("n"))))

    def in_blocks(blocks: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).alias("skip"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), start, step(blocks), lambda s: F.struct(F.array_join(s["t"], "").alias("t"), s["n"].alias("n")))

    address = F.struct(new_email(x, key).alias("t"), F.lit(1).alias("n"))
    return F.when(F.instr(x, "@") > 0, address).otherwise(let(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), in_blocks))


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, n_values): the text with each validated value replaced, and how many were."""

    def of(found: Column) -> Column:
        new = F.transform(found, lambda x: renewed(x, key))
        whole = lambda n: F.array_join(F.zip_with(F.split(text, ANY, -1), n["t"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return let(new, lambda n: F.struct(whole(n).alias("text"), F.aggregate(n["n"], F.lit(0).cast("long"), lambda a, b: a + b).alias("n_values")))

    kept = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_values"))
    return F.when(text.isNull() | ~text.rlike(HINT), kept).otherwise(let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda found: F.when(F.size(found) == 0, kept).otherwise(of(found))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The same rows and columns, with the texts' personal values replaced."""
    return docs.withColumn("text", pseudonymised(F.col("text"), key)["text"])


def op3_feistel_pii(spark, sf_dir: str) -> DataFrame:
    done = pseudonymised(F.col("text"), session_key(spark))
    return table(spark, sf_dir, "documents").select("doc_id", done.alias("r")).select("doc_id", "r.text", "r.n_values")
