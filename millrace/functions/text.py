"""Column functions on texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


#: White space at which texts are stripped, and line ends, beyond ASCII too.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """A text without the white space around it."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def has_any(text: Column, marks: list[str]) -> Column:
    """Whether a text holds one of the marks; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(m) for m in marks]), F.lit(False))


def words(text: Column) -> Column:
    """Lower-cased words of two letters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{2,}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Tokens, then all pairs of neighbours."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))
    return F.concat(tokens, F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def clean_lines(text: Column, least: int = 4) -> Column:
    """Trimmed lines of ``least`` characters or more, with a blank line between them; null gives an empty text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip)
    return F.array_join(F.filter(lines, lambda x: F.length(x) >= least), "\n\n")


def trim_boilerplate(text: Column, extra: list[str] = (), keep: int = 150) -> Column:
    """Cuts a text before the first line with boilerplate that stands behind ``keep`` characters of other lines."""
    marks = C.BOILERPLATE + list(extra)
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("line"), F.lit(-1).alias("cut"))

    def step(s: Column, line: Column) -> Column:
        """``cut`` is the number of the first line that goes; the lines themselves are not copied."""
        over = (s["cut"] < 0) & (s["seen"] >= keep) & has_any(line, marks)
        return F.struct((s["seen"] + F.length(strip(line))).alias("seen"), (s["line"] + 1).alias("line"), F.when(over, s["line"]).otherwise(s["cut"]).alias("cut"))

    def trimmed(lines: Column) -> Column:
        cut = F.aggregate(lines, start, step, lambda s: s["cut"])
        return F.get(F.transform(F.array(cut), lambda n: F.when(n < 0, lines).otherwise(F.slice(lines, F.lit(1), n))), F.lit(0))

    return strip(F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), trimmed), F.lit(0)), "\n"))


def cjk_ratio(text: Column) -> Column:
    """Share of CJK characters; 0 for an empty text or null."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", "")) / n).otherwise(F.lit(0.0))


def punctuation_density(text: Column) -> Column:
    """Share of full-width punctuation; 0 for an empty text or null."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.translate(text, "。，！？；：、", ""))) / n).otherwise(F.lit(0.0))


def wrap_untrusted(text: Column, tag: str = "DATA") -> Column:
    """A text between tags, in which the tags themselves and code fences are made harmless."""
    t = F.coalesce(text, F.lit(""))
    for old, new in ((f"</{tag}>", f"<​/{tag}>"), (f"<{tag}>", f"<​{tag}>"), ("```", "ˋˋˋ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.concat(F.lit(f"<{tag}>\n"), t, F.lit(f"\n</{tag}>"))


def csv_safe(cell: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(F.coalesce(cell, F.lit("")))


def json_object(raw: Column) -> Column:
    """What stands from the first brace to the last, without a code fence; the text itself if there is none."""
    s = strip(F.coalesce(raw, F.lit("")))
    s = strip(F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(s)


def demote_headings(markdown: Column) -> Column:
    """Headings of level 1 to 5 become one lower."""
    deeper = F.transform(F.split(markdown, "\n"), lambda x: F.when(x.rlike("^#{1,5}\\s"), F.concat(F.lit("#"), x)).otherwise(x))
    return F.array_join(deeper, "\n")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def color_family(code: Column) -> Column:
    """One of twelve families of a colour like ``#a0b1c2``; empty if it is none."""
    h = F.regexp_replace(code, "^#+", "")
    rgb = F.struct(*[(F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255).alias(c) for i, c in ((1, "r"), (3, "g"), (5, "b"))])

    def shade(x: Column) -> Column:
        v, c = F.greatest(x["r"], x["g"], x["b"]), F.greatest(x["r"], x["g"], x["b"]) - F.least(x["r"], x["g"], x["b"])
        turn = F.when(c == 0, F.lit(0.0)).when(v == x["r"], F.pmod((x["g"] - x["b"]) / c, F.lit(6.0))).when(v == x["g"], (x["b"] - x["r"]) / c + 2).otherwise((x["r"] - x["g"]) / c + 4)
        return F.struct(v.alias("v"), F.when(v > 0, c / v).otherwise(F.lit(0.0)).alias("s"), (turn * 60).alias("deg"))

    def family(x: Column) -> Column:
        dark, pale, bright, edge, brown = C.COLOR_LIMITS
        name = F.when(x["v"] < dark, "黑").when((x["s"] < pale) & (x["v"] > bright), "白").when(x["s"] < pale, "灰")
        name = name.when((x["deg"] < edge) | (x["deg"] >= 360 - edge), "紅").when((x["deg"] < 45) & (x["v"] < brown), "金或暖棕")
        for limit, kind in C.HUES:
            name = name.when(x["deg"] < limit, kind)
        return name.otherwise("粉或洋紅")

    # lambdas over an array of one bind each step once
    named = F.get(F.transform(F.transform(F.array(rgb), shade), family), F.lit(0))
    return F.when(h.rlike("^[0-9a-fA-F]{6}"), named).otherwise("")


def browser_error(content: Column) -> Column:
    return F.coalesce((F.length(content) < 1500) & has_any(content, C.BROWSER_ERRORS), F.lit(False))


def _blob(content: Column, title: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))


def http_error(content: Column, title: Column) -> Column:
    return has_any(_blob(content, title), C.HTTP_ERRORS)


def block_page(content: Column, title: Column) -> Column:
    return has_any(_blob(content, title), C.BLOCK_PAGES) & (F.length(strip(F.coalesce(content, F.lit("")))) < 1200)


def cms(html: Column) -> Column:
    """Kind of system that made a page, from its first 200,000 characters."""
    h = F.substring(html, 1, 200_000)
    has = lambda *marks: has_any(h, list(marks))
    next_js = has("__next", "self.__next_f")
    ld = has('"articleBody"') & has("application/ld+json")
    return (
        F.when(has("fullpage-content", 'class="fullpage'), "fullpage.js")
        .when(has("listicle-body-content", "article__body-content"), "hearst")
        .when(ld & next_js, "nextjs-rsc+jsonld")
        .when(ld, "jsonld")
        .when(next_js | has('["$","p"'), "nextjs-rsc")
        .when(has("wp-content", "wp-includes"), "wordpress")
        .otherwise("generic")
    )


def llm_cost(model: Column, prompt: Column, output: Column) -> Column:
    """US dollars, to four places."""
    price_in, price_out = (F.lit(p) for p in C.DEFAULT_PRICE)
    for part, a, b in reversed(C.PRICES):
        fits = F.lower(F.coalesce(model, F.lit(""))).contains(part)
        price_in, price_out = F.when(fits, a).otherwise(price_in), F.when(fits, b).otherwise(price_out)
    return F.bround(F.coalesce(prompt, F.lit(0)) / 1_000_000 * price_in + F.coalesce(output, F.lit(0)) / 1_000_000 * price_out, 4)


def paywall(content: Column, url: Column) -> Column:
    """``paywall`` if a text leads on to paid content, ``paywall_short`` if it is shorter than its host's whole texts, else empty."""
    out = F.lit("")
    for name, least in C.PAYWALL_HOSTS.items():
        out = F.when(F.lower(F.coalesce(url, F.lit(""))).contains(name) & (F.length(F.coalesce(content, F.lit(""))) < least), "paywall_short").otherwise(out)
    return F.when(has_any(content, C.PAYWALL), "paywall").otherwise(out)


def cookie_banner(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(t.contains(k), 1).otherwise(0) for k in C.COOKIES), F.lit(0)) >= 3


def shown(number: Column, places: int = 4) -> Column:
    """A number with a point and one digit behind it at least, without zeros at its end; empty for null."""
    return F.coalesce(F.regexp_replace(number.cast(f"decimal(20,{places})").cast("string"), r"(\.\d+?)0+$", "$1"), F.lit(""))


def csv_line(cells: list[Column]) -> Column:
    """A line of a table: cells that no spreadsheet takes for a formula, in quotes where they need them, and a line end."""

    def quoted(cell: Column) -> Column:
        safe = csv_safe(cell.cast("string"))
        return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return F.concat(F.concat_ws(",", *map(quoted, cells)), F.lit("\r\n"))
