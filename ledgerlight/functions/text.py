"""String, date and unit scalars."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words of units.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


def _bind(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is read."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fiscal_year(end: Column, year_end: str) -> Column:
    """'FY2025': the fiscal year, closing on MM-DD, that a date falls in."""
    return F.concat(F.lit("FY"), (F.year(end) + F.when(F.date_format(end, "MM-dd") <= year_end, 0).otherwise(1)).cast("string"))


def currency_of(unit: Column) -> Column:
    found = F.regexp_extract(unit, "^([A-Z]{3})(/shares)?$", 1)
    return F.when(found != "", found)


def scaled_unit(unit: Column) -> Column:
    """(base, multiplier) of 'million tons' and the like; the scale word must come first."""
    word = F.split(unit, " ")[0]
    factor = F.lit(None).cast("double")
    for name, x in SCALES.items():
        factor = F.when(word == name, x).otherwise(factor)
    return F.struct(F.when(factor.isNull(), unit).otherwise(F.regexp_replace(unit, "^[^ ]+ ?", "")).alias("base"), F.coalesce(factor, F.lit(1.0)).alias("multiplier"))


#: White space as line ends and at the ends of lines.
_ENDS, _SPACE = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+", r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _char(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def unescaped(text: Column) -> Column:
    """Character references as characters; those that are unknown stay."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))])

    def piece(p: Column) -> Column:
        name, dec = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(p, "^#([0-9]{1,7});", 1)
        hexa = F.regexp_extract(p, "^#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(dec != "", dec.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        char = F.when(name == "apos", "'").when(name != "", F.try_element_at(names, name)).when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), _char(code))
        return F.when(char.isNotNull(), F.concat(char, F.regexp_replace(p, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), p))

    whole = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))
    return _bind(F.split(text, "&"), lambda parts: F.when(F.size(parts) > 1, whole(parts)).otherwise(parts[0]))


def html_to_text(html: Column) -> Column:
    """Plain text: no scripts, styles and comments; a new line for block tags, a tab for cells; references as characters; no blank lines."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)", "")
    t = F.regexp_replace(t, r"(?i)<(?:p|br|tr|div|li|h[1-3])(?=[\s/>])[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)<t[dh](?=[\s/>])[^>]*>", "\t")
    t = unescaped(F.regexp_replace(t, r"(?s)<[/!?A-Za-z][^>]*>", ""))
    lines = F.transform(F.split(t, _ENDS), lambda x: F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def numbers(text: Column) -> Column:
    """Number tokens of a text in one spelling: no separators of thousands inside a token, a point for a decimal comma."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return F.transform(found, lambda n: F.replace(merged_thousands(n), F.lit(","), F.lit(".")))


def number_guard(answer: Column, allowed: Column) -> Column:
    """(ok, citations) of an answer: refused if a number stands in it more often than in all the *allowed* texts (an array)."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    have = F.flatten(F.transform(allowed, numbers))
    fits = lambda x: F.forall(F.array_distinct(x["found"]), lambda n: times(x["found"], n) <= times(x["have"], n))
    both = F.struct(numbers(answer).alias("found"), have.alias("have"))
    return _bind(both, lambda x: _bind(fits(x), lambda ok: F.struct(ok.alias("ok"), F.when(ok, F.array_sort(x["found"])).alias("citations"))))


#: Parameters of a URL that are never kept.
SECRET_PARAMETERS = ("key", "token", "apikey", "api_key", "access_token", "password")


def scrub(url: Column) -> Column:
    """The URLs of a text without secret parameters; the others stay as they are written."""
    names = "|".join(SECRET_PARAMETERS)
    out = F.regexp_replace(url, rf"(?i)(?<=[?&])(?:{names})(?:=[^&#\s]*)?(?:&|(?=#|\s|$))", "")
    return F.regexp_replace(out, r"[?&](?=#|\s|$)", "")


def merged_thousands(text: Column) -> Column:
    """'1 234' and '1,234' as '1234': the separator of a group of three digits goes."""
    return F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"(?<=\d)[, ](?=\d{3}(?:\D|$))", "")


def plain_number(text: Column) -> Column:
    """Sign, digits and one decimal point style of a text that is a number, else null; '42' and '42.0' stay apart."""
    t = F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" ")))
    sign, body = F.when(t.startswith("-"), "-").otherwise(""), F.trim(F.regexp_replace(t, r"^[+-]", ""))
    n = F.replace(merged_thousands(body), F.lit(","), F.lit("."))
    return F.when(n.rlike(r"^\d+(?:[.,]\d+)*$"), F.concat(sign, n))


def quote_status(value: Column, quote: Column, page: Column) -> Column:
    """verified: the quote stands on the page and its numbers have the value; near_miss: only its digits do; else failed."""
    here = (quote != "") & page.contains(quote)
    found = F.transform(F.regexp_extract_all(merged_thousands(quote), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    digits = lambda t: F.concat(F.regexp_extract(t, r"^[\s\u00a0]*([+-]?)", 1), F.regexp_replace(t, r"[^0-9]", ""))
    near = digits(value).rlike("[0-9]") & digits(quote).contains(digits(value))
    return F.when(~F.coalesce(here, F.lit(False)), "failed").when(F.coalesce(F.array_contains(found, plain_number(value)), F.lit(False)), "verified").when(near, "near_miss").otherwise("failed")


#: Number words of depositary ratios.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20,
    "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50, "hundred": 100, "one hundred": 100,
}


#: Words of a depositary share's name, and verbs that come before its number of shares.
DEPOSITARY, NAME = ("depositary", "ads", "adss", "adr", "adrs"), ("american", "share", "shares")
TELLS = ("representing", "represents", "representative")


def ads_ratio(text: Column) -> Column:
    """Shares in one depositary share, as a report's text tells; null where it does not, and for 0 and over 1000.

    Read word by word within a sentence: 'each' and a verb, the number of shares behind it. The depositary share is named earlier in
    the sentence, or between the two; sentences that name it earlier go first.
    """
    number = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, float(n))])
    named = lambda w: w.isin(*DEPOSITARY)
    sentences = F.split(F.lower(F.replace(text, F.lit("\u00a0"), F.lit(" "))), r"[.;](?!\d)")

    def told(words: Column) -> Column:
        """The numbers of one sentence, each with how it names the share."""

        def at(i: Column) -> Column:
            word, before, of = F.get(words, i), F.slice(words, F.lit(1), i), F.get(words, i + 1) == "of"
            first = F.get(words, i + 1 + of.cast("int"))
            both = F.try_element_at(number, F.concat_ws(" ", first, F.get(words, i + 2 + of.cast("int"))))
            value = F.coalesce(both, F.try_element_at(number, first), F.when(first.rlike(r"^\d"), first.try_cast("double")))
            last = i - F.array_position(F.reverse(before), "each")  # the place of the last 'each'
            between = F.slice(words, last + 2, i - last - 1)
            # 'representative' goes with 'of', the others without
            well = (word == "representative") == of
            earlier = (last == i - 1) & F.exists(before, named)
            inside = (word != "representative") & F.exists(between, named) & F.forall(between, lambda w: w.isin(*DEPOSITARY, *NAME))
            rank = F.when(~F.array_contains(before, "each") | ~well, None).when(earlier, 0).when(inside, 1)
            return F.struct(rank.alias("rank"), value.alias("value"))

        places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(F.get(words, i).isin(*TELLS), F.lit(False)))
        return F.filter(F.transform(places, at), lambda x: x["rank"].isNotNull() & x["value"].isNotNull())

    words = F.transform(sentences, lambda s: F.filter(F.split(s, r"[^a-z0-9.\-]+"), lambda w: w != ""))
    found = F.flatten(F.transform(words, told))
    value = _bind(found, lambda x: F.coalesce(F.get(F.filter(x, lambda y: y["rank"] == 0), F.lit(0)), F.get(x, F.lit(0)))["value"])
    return F.when((value > 0) & (value <= 1000), value)


def period_bounds(period: Column, year_end: Column) -> Column:
    """(start, end, type) of 'FY2025', '2025', a date or anything else; a fiscal year ends on *year_end* (MM-DD), else in December."""
    t = F.coalesce(F.trim(period), F.lit(""))
    year = F.regexp_extract(t, r"^(?:(?:FY|fy)\s*)?(\d{4})$", 1)
    end = F.coalesce(F.to_date(F.try_to_timestamp(F.concat_ws("-", year, year_end), F.lit("yyyy-MM-dd"))), F.to_date(F.concat(year, F.lit("-12-31"))))
    start = F.date_add(F.add_months(end, -12), 1)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))
    other = F.when(t == "", "unknown").otherwise(t)
    pick = lambda y: F.when(year != "", y.cast("string")).when(day.isNotNull(), t).otherwise(other)
    return F.struct(pick(start).alias("start"), pick(end).alias("end"), F.when(year != "", "duration").otherwise("instant").alias("type"))


#: Scale words of manual units.
MANUAL_SCALES = {"thousand": 1e3, "th": 1e3, "k": 1e3, "000": 1e3, "million": 1e6, "mn": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9}


def unit_shape(unit: Column) -> Column:
    """(scale, currency, reason) of a manual record's unit: rates, unknown words and empty units are refused by name."""
    t = F.trim(F.coalesce(unit, F.lit("")))
    tokens = F.transform(F.split(F.translate(t, ",", " "), r"\s+"), lambda x: F.regexp_replace(x, "^['’\"`().]+|['’\"`().]+$", ""))
    tokens = F.filter(tokens, lambda x: x != "")
    scales = F.create_map(*[F.lit(x) for w, n in MANUAL_SCALES.items() for x in (w, n)])
    iso = F.filter(tokens, lambda x: x.rlike("^[A-Z]{3}$"))
    bare = F.filter(F.transform(F.filter(tokens, lambda x: ~x.rlike("^[A-Z]{3}$")), lambda x: F.lower(F.translate(x, "$€£₽¥₴₹", ""))), lambda x: x != "")
    odd = F.filter(bare, lambda x: ~F.map_contains_key(scales, x))
    scale = F.try_element_at(scales, F.try_element_at(bare, F.lit(-1)))
    why = F.when(t == "", "empty_unit").when(t.contains("/") | F.lower(t).contains(" per "), "rate_unit").when(F.size(odd) > 0, F.concat(F.lit("unknown_unit:"), F.try_element_at(odd, F.lit(1))))
    why = why.when((F.size(bare) == 0) & (F.size(iso) == 0), "unknown_unit")
    return F.struct(F.when(why.isNull(), F.coalesce(scale, F.lit(1.0))).alias("scale"), F.when(why.isNull(), F.try_element_at(iso, F.lit(1))).alias("currency"), why.alias("reason"))


#: Fixed value: what looks like a ticker, a class after a point included.
TICKER = r"\b[A-Z][A-Z0-9]{1,5}(?:\.[A-Z]{1,3})?\b"


def tickers(text: Column) -> Column:
    """Words that look like tickers, each once, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TICKER), F.lit(0)))


def year_before(day: Column) -> Column:
    """The same day a year earlier; the end of February of a leap year is its 28th."""
    return F.add_months(day, -12)


def filled_in(template: Column, values: Column) -> Column:
    """A text with {{concept}} replaced by the value of a map; what the map lacks stays as it is."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*([a-z_0-9]+)\s*\}\}"), F.lit(1)))
    parts = F.split(template, r"\{\{")

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\s*([a-z_0-9]+)\s*\}\}", 1)
        value = F.try_element_at(values, name)
        return F.when((name != "") & value.isNotNull(), F.concat(value, F.regexp_replace(p, r"^[^}]*\}\}", ""))).otherwise(F.concat(F.lit("{{"), p))

    rest = F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), "")
    return F.when(F.size(names) > 0, F.concat(parts[0], rest)).otherwise(template)


def shown_number(value: Column, kind: Column, unit: Column) -> Column:
    """A number for a table: shares as percent, multiples with a cross, money from a million on in words, else four digits."""
    group = lambda x: F.replace(F.replace(F.format_number(x, 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    size = F.abs(value)
    money = unit.rlike("^[A-Z]{3}$")
    words = F.when(money & (size >= 1e12), F.concat(group(value / 1e12), F.lit(" trn "), unit)).when(money & (size >= 1e9), F.concat(group(value / 1e9), F.lit(" bn "), unit))
    words = words.when(money & (size >= 1e6), F.concat(group(value / 1e6), F.lit(" m "), unit))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), "no data").when(kind == "percent", F.concat(group(value * 100), F.lit(" %"))).when(kind == "multiple", F.concat(group(value), F.lit("×"))).otherwise(F.coalesce(words, plain))


def stale_mark(end: Column, newest: Column, most: int = 1100) -> Column:
    return F.when(F.datediff(newest, end) > most, F.concat(F.lit("last "), end.cast("string")))
