"""Format-preserving Feistel pseudonyms for personal data, in Spark expressions only.

Each value found is checked first (Luhn for card numbers, octets for
addresses, the calendar for dates) and then permuted by a keyed Feistel
network inside its own format: a card number becomes another valid card
number, a date another date, a letter stays a letter of the same case. The
permutation depends on key and value alone, so equal values get equal
pseudonyms in every document, and distinct values stay distinct.

Round function: SHA-256 over key, round number and the other half.

Kinds, as found from left to right without overlap:

* secrets: ``AKIA`` ids by character class, and hexadecimal strings of 16 or
  more digits as numbers, in either case: the spellings of one number get one
  pseudonym, whose letters follow the case of the value;
* e-mail addresses: the local part and the host labels before the last two
  (a two-label host: the first), by character class;
* IPv4 addresses, every octet 0 to 255: a permutation of all 32-bit numbers;
* telephone numbers in international form (``+`` and 7 to 15 digits, with or
  without single separators and parentheses) or ``ddd-ddd-dddd``: all digits
  after the country code, alike in every layout;
* social security numbers ``ddd-dd-dddd``: all digits;
* card numbers of 13 to 19 digits with a right check digit, plain or in groups
  with single spaces or hyphens between: all digits but the last, which is
  computed anew. Among other numbers a card is found plain or in the groups
  4-4-4-4, 4-6-4, 4-6-5, 4-4-4-4-1 to 4-4-4-4-3; in other groups where they
  stand alone;
* dates ``yyyy-mm-dd``, ``yyyy/mm/dd``, ``dd.mm.yyyy`` that are in the calendar,
  1900 to 2099: a permutation of those 73,049 days (cycle walking).

A value that fails its check is no personal data and stays as it is.

Defined results: null text stays null, an empty text stays empty, repeated
rows are treated alike, an empty table gives no rows, further columns pass
through. Only IPv4 addresses may change length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A deployment passes its own secret; the registered query uses this one.
KEY = "assaybook-demo-key"
ROUNDS = 6

SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])"
EMAIL = r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IPV4 = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\.?\d)"
PHONE = (
    r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\+1[ ./-]?\d{3}[ ./-]?\d{3}[ ./-]?\d{4}(?!\d)"
    r"|(?<!\d)\+[1-9](?:[ ./-]?\(?\d\)?){6,14}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
)
#: E.164 country codes of one or two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d./-])(?:(?:19|20)\d\d([-/])\d\d\1\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d/-]|\.\d)"
_OTHERS = (("secret", SECRET), ("email", EMAIL), ("ipv4", IPV4), ("phone", PHONE), ("ssn", SSN), ("date", DATE.replace(r"\1", r"[-/]")))
# a run of digit groups, as long as no group begins a value of another kind
CARD = r"(?<![\d.])(?=\d(?:[ -]?\d){12})\d++(?!\.\d)(?:[ -](?!" + "|".join(p for _, p in _OTHERS) + r")\d++(?!\.\d))*+"
_KINDS = (*_OTHERS, ("card", CARD))
#: The usual layouts of a card number in a run: plain, 4-4-4-4, 4-6-4 and 4-6-5; and then the one of 17 to 19 digits.
LAYOUT = r"^[ -]?(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
LONG_LAYOUT = r"^[ -]?\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}(?!\d)"
ANY = "|".join(f"(?:{p})" for _, p in _KINDS)
_DAYS = 73_049  # 1900-01-01 to 2099-12-31


def _stream(half: Column, key: str, tag: str, turn: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tag}|{turn}|"), half), 256)


def _shifted(half: Column, stream: Column, sign: int) -> Column:
    """Each letter or digit of ``half`` moved inside its class by a number from the key stream."""

    def one(c: Column, i: Column) -> Column:
        # 16 two-digit numbers a block of 64 hexadecimal digits would bound the length, so the stream is read cyclically
        n = F.conv(F.substring(stream, (i * 3) % 61 + 1, 4), 16, 10).cast("int") + i
        code = F.ascii(c)

        def within(first: str, size: int) -> Column:
            base = ord(first)
            return F.char((F.pmod(code - base + n * sign, F.lit(size)) + base).cast("long"))

        return F.when(c.rlike("^[0-9]$"), within("0", 10)).when(c.rlike("^[a-z]$"), within("a", 26)).when(c.rlike("^[A-Z]$"), within("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def feistel_text(value: Column, key: str = KEY, tag: str = "text", undo: bool = False) -> Column:
    """Permutation of the strings with the same length and character classes.

    The halves are the first ``n // 2`` characters and the rest; round ``r``
    shifts one half by a stream drawn from the other. One character alone is
    shifted by the key.
    """
    cut = F.floor(F.length(value) / 2).cast("int")
    pair = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))

    def turned(pair: Column, turn: int) -> Column:
        sign = -1 if undo else 1
        if turn % 2:
            return _bound(pair, lambda p: F.struct(_shifted(p["a"], _stream(p["b"], key, tag, turn), sign).alias("a"), p["b"].alias("b")))
        return _bound(pair, lambda p: F.struct(p["a"].alias("a"), _shifted(p["b"], _stream(p["a"], key, tag, turn), sign).alias("b")))

    for turn in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        pair = turned(pair, turn)
    return _bound(pair, lambda p: F.concat(p["a"], p["b"]))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable stands for it.

    ``body`` must have one parameter; a second one, even with a default, would be the element's index.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel_number(value: Column, bits: int, key: str = KEY, tag: str = "number", undo: bool = False) -> Column:
    """Balanced Feistel permutation of the numbers below ``2 ** bits`` (an even number of bits)."""
    half = bits // 2
    mask = (1 << half) - 1
    pair = F.struct(F.shiftright(value, half).alias("a"), value.bitwiseAND(mask).alias("b"))

    def drawn(x: Column, turn: int) -> Column:
        return F.conv(F.substring(_stream(x.cast("string"), key, tag, turn), 1, 8), 16, 10).cast("long").bitwiseAND(mask)

    def turned(pair: Column, turn: int) -> Column:
        if undo:
            return _bound(pair, lambda p: F.struct(p["b"].bitwiseXOR(drawn(p["a"], turn)).alias("a"), p["a"].alias("b")))
        return _bound(pair, lambda p: F.struct(p["b"].alias("a"), p["a"].bitwiseXOR(drawn(p["b"], turn)).alias("b")))

    for turn in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        pair = turned(pair, turn)
    return _bound(pair, lambda p: F.shiftleft(p["a"], half) + p["b"])


def feistel_below(value: Column, bound: int, key: str = KEY, tag: str = "number") -> Column:
    """Permutation of the numbers below ``bound``: the smallest even-bit network, walked until it lands inside.

    A walk leaves the domain with a chance under 3/4 a step; 64 steps are
    unrolled in a fold, and a value that never lands (1e-8 at the worst) is
    impossible for the registered domains, which tests enumerate.
    """
    bits = max(2, (bound - 1).bit_length() + (bound - 1).bit_length() % 2)
    steps = F.sequence(F.lit(1), F.lit(64))
    start = feistel_number(value, bits, key, tag)
    return F.aggregate(steps, start, lambda v, _: F.when(v < bound, v).otherwise(feistel_number(v, bits, key, tag)))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of a digit string with every second digit doubled, from the last (``doubled_last``) or the last but one."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        from_end = n - 1 - i
        twice = (from_end % 2) == (0 if doubled_last else 1)
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda s, d: s + d)


def luhn_valid(digits: Column) -> Column:
    return luhn_sum(digits, False) % 10 == 0


def _laid_out(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    parts = F.split(F.regexp_replace(shape, r"\d", "\u0001$0"), "\u0001")
    return F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.split(digits, ""), lambda part, d: F.concat(d, F.substring(part, 2, 1 << 30))), ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def card(value: Column, key: str) -> Column:
    """A run of digit groups with its card numbers replaced: those in a usual layout, or else the whole run."""

    def permuted(text: Column) -> Column:
        body = lambda d: feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        checked = lambda b: F.concat(b, F.pmod(-luhn_sum(b, True), F.lit(10)).cast("string"))
        return _laid_out(text, _bound(_bound(_digits(text), body), checked))

    valid = lambda text: (F.length(text) > 0) & luhn_valid(F.concat(F.lit("0"), _digits(text)))

    def found(rest: Column) -> Column:
        short, long = F.regexp_extract(rest, LAYOUT, 0), F.regexp_extract(rest, LONG_LAYOUT, 0)
        return F.when(valid(short), short).when(valid(long), long).otherwise(F.lit(""))

    def spans(groups: Column) -> Column:
        """Place and number of groups of each card number, from left to right; ``past`` is the first group after the last."""

        def step(s: Column, i: Column) -> Column:
            size = lambda t: F.size(F.split(t, "(?<=[0-9])[ -]"))
            take = lambda t: F.when(t == "", s).otherwise(F.struct(F.concat(s["hits"], F.array(F.struct(i.alias("at"), size(t).alias("n")))).alias("hits"), (i + size(t)).alias("past")))
            return F.when(i < s["past"], s).otherwise(_bound(found(F.array_join(F.slice(groups, i, F.lit(5)), "")), take))

        start = F.struct(F.array().cast("array<struct<at: int, n: int>>").alias("hits"), F.lit(1).alias("past"))
        alone = F.length(_digits(value)).between(13, 19) & luhn_valid(F.concat(F.lit("0"), _digits(value)))
        every = F.array(F.struct(F.lit(1).alias("at"), F.size(groups).alias("n")))
        return _bound(F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step)["hits"], lambda h: F.when((F.size(h) == 0) & alone, every).otherwise(h))

    def rebuilt(groups: Column, hits: Column) -> Column:
        text = lambda first, past: F.array_join(F.slice(groups, first, past - first), "")
        end = lambda i: F.coalesce(F.get(hits, i)["at"] + F.get(hits, i)["n"], F.lit(1))
        parts = F.transform(hits, lambda h, i: F.concat(text(end(i - 1), h["at"]), permuted(text(h["at"], h["at"] + h["n"]))))
        return F.concat(F.array_join(parts, ""), text(end(F.size(hits) - 1), F.size(groups) + 1))

    return _bound(F.split(value, "(?=[ -])"), lambda g: _bound(spans(g), lambda h: F.when(F.size(h) == 0, value).otherwise(rebuilt(g, h))))


def ipv4(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + o.cast("long"))
    octet = lambda n, shift: F.shiftright(n, shift).bitwiseAND(255).cast("string")
    return _bound(feistel_number(number, 32, key, "ipv4"), lambda n: F.concat_ws(".", octet(n, 24), octet(n, 16), octet(n, 8), octet(n, 0)))


def email(value: Column, key: str) -> Column:
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(host, r"\.")
    own = F.greatest(F.size(labels) - 2, F.lit(1))
    hidden = F.transform(labels, lambda x, i: F.when(i < own, feistel_text(x, key, "host")).otherwise(x))
    return F.concat(feistel_text(local, key, "local"), F.lit("@"), F.array_join(hidden, "."))


def phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    code = F.when(value.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise(F.lit(""))
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _laid_out(value, F.concat(code, feistel_text(rest, key, "phone")))


def date(value: Column, key: str) -> Column:
    dotted = value.contains(".")
    iso = F.when(dotted, F.concat(F.substring(value, 7, 4), F.lit("-"), F.substring(value, 4, 2), F.lit("-"), F.substring(value, 1, 2))).otherwise(F.translate(value, "/", "-"))
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
    moved = F.date_add(F.lit("1900-01-01").cast("date"), feistel_below(day.cast("long"), _DAYS, key, "date").cast("int"))
    text = F.when(dotted, F.date_format(moved, "dd.MM.yyyy")).when(value.contains("/"), F.date_format(moved, "yyyy/MM/dd")).otherwise(F.date_format(moved, "yyyy-MM-dd"))
    return F.coalesce(text, value)


def kind_of(value: Column) -> Column:
    """The kind of a value that ``ANY`` found."""
    out = F.when(value.rlike("@"), F.lit("email"))
    for name, pattern in (("secret", r"^AKIA|[A-Fa-f]"), ("ipv4", r"^\d{1,3}(?:\.\d{1,3}){3}$"), ("phone", r"^\+|^\d{3}-\d{3}-\d{4}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("date", r"^\d{4}[-/]\d\d[-/]\d\d$|^\d\d\.\d\d\.\d{4}$")):
        out = out.when(value.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("card"))


def pseudonym(value: Column, key: str = KEY) -> Column:
    kind = kind_of(value)
    return (
        F.when(kind == "email", email(value, key))
        .when(kind == "secret", F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), feistel_text(F.substring(value, 5, 16), key, "akia"))).otherwise(feistel_hex(value, key)))
        .when(kind == "ipv4", ipv4(value, key))
        .when(kind == "phone", phone(value, key))
        .when(kind == "ssn", _bound(value, lambda v: _laid_out(v, feistel_text(_digits(v), key, "ssn"))))
        .when(kind == "date", date(value, key))
        .otherwise(card(value, key))
    )


def feistel_hex(value: Column, key: str = KEY) -> Column:
    """Permutation of hexadecimal strings as numbers, each letter in the case of the value at its place (at a digit's place, of its first letter)."""
    first = F.regexp_extract(value, "[A-Fa-f]", 0)

    def cased(new: Column) -> Column:
        like = lambda c: F.when(c.rlike("[A-F]"), True).when(c.rlike("[a-f]"), False).otherwise(first.rlike("[A-F]"))
        return F.array_join(F.zip_with(F.split(new, ""), F.split(value, ""), lambda n, c: F.when(like(c), F.upper(n)).otherwise(n)), "")

    return F.when(value.rlike("[A-F]"), _bound(_feistel_lower_hex(F.lower(value), key), cased)).otherwise(_feistel_lower_hex(value, key))


def _feistel_lower_hex(value: Column, key: str) -> Column:
    """Permutation of lower-case hexadecimal strings: 16 digits at a time, each half a 32-bit number; what is left by digit class."""
    whole = F.floor(F.length(value) / 16).cast("int")
    block = lambda i: F.substring(value, i * 16 + 1, F.lit(16))

    def one(b: Column) -> Column:
        number = lambda x: F.conv(x, 16, 10).cast("long")
        pair = F.struct(number(F.substring(b, 1, 8)).alias("a"), number(F.substring(b, 9, 8)).alias("b"))

        def turned(pair: Column, turn: int) -> Column:
            drawn = lambda x: number(F.substring(_stream(x.cast("string"), key, "hex", turn), 1, 8))
            return _bound(pair, lambda p: F.struct(p["b"].alias("a"), p["a"].bitwiseXOR(drawn(p["b"])).alias("b")))

        for turn in range(ROUNDS):
            pair = turned(pair, turn)
        text = lambda n: F.lower(F.lpad(F.hex(n), 8, "0"))
        return _bound(pair, lambda p: F.concat(text(p["a"]), text(p["b"])))

    blocks = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: _bound(block(i), one))
    rest = F.substring(value, whole * 16 + 1, F.length(value))
    tail = F.transform(F.split(rest, ""), lambda c, i: F.lower(F.hex(F.conv(c, 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(_stream(block(F.lit(0)), key, "hex-tail", 0), i + 1, F.lit(1)), 16, 10).cast("long")))))
    return F.concat(F.array_join(blocks, ""), F.when(F.length(rest) > 0, F.array_join(tail, "")).otherwise(F.lit("")))


def masked(text: Column, key: str = KEY) -> Column:
    """The text with every checked value replaced by its pseudonym.

    The pattern cuts the text into what lies between the values and the values
    themselves; both sides come from one left-to-right scan rule, so they
    interleave. Texts without a match skip all that.
    """
    between = F.split(text, ANY, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: pseudonym(v, key))
    joined = F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    # every kind implies one of these: the cheap test first
    return F.when(text.rlike(r"@[A-Za-z0-9]|\d[ ./-]?[()]?[ ./-]?[()]?\d|AKIA|[0-9A-Fa-f]{16}"), joined).otherwise(text)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the texts masked; all other columns as they are."""
    return docs.withColumn(text_col, masked(F.col(text_col), key))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text masked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
