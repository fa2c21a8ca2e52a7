"""Text, HTML and URL functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.functions.columns import let, strip

#: Named character references; fixed values.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
}
#: Elements that are no content, and elements that end a line; fixed values.
CHROME = ("script", "style", "nav", "footer", "header", "noscript", "head", "title")
BLOCKS = ("p", "div", "br", "li", "tr", "ul", "ol", "table", "section", "article", "blockquote")
HEADING_MARK, LEVEL_MARK = "\x1e", "\x1f"
#: Path parts that are no category; fixed values.
NO_CATEGORY = ("en", "us", "docs", "index", "learn", "wiki")

#: Relation verbs in use and what others are called; fixed values.
RELATIONS = (
    "founded", "invented", "discovered", "developed", "created", "led", "directed", "authored", "influenced", "inspired", "part_of", "uses", "requires",
    "caused", "resulted_in", "fought_in", "participated_in", "born_in", "died_in", "located_in", "related_to",
)
SYNONYMS = {
    "established": "founded", "co_founded": "founded", "cofounded": "founded", "set_up": "founded",
    "built": "created", "made": "created", "constructed": "created", "designed": "created",
    "devised": "invented", "conceived": "invented", "patented": "invented",
    "found": "discovered", "uncovered": "discovered", "identified": "discovered",
    "built_on": "developed", "advanced": "developed", "improved": "developed", "refined": "developed",
    "headed": "led", "managed": "led", "chaired": "led", "ran": "led", "supervised": "directed", "oversaw": "directed",
    "wrote": "authored", "published": "authored", "co_authored": "authored",
    "affected": "influenced", "impacted": "influenced", "shaped": "influenced", "motivated": "inspired",
    "component_of": "part_of", "member_of": "part_of", "belongs_to": "part_of", "subset_of": "part_of",
    "employs": "uses", "utilizes": "uses", "relies_on": "requires", "depends_on": "requires", "needs": "requires",
    "led_to": "caused", "triggered": "caused", "produced": "resulted_in", "generated": "resulted_in",
    "battled_in": "fought_in", "served_in": "participated_in", "engaged_in": "participated_in", "took_part_in": "participated_in",
}


def collapse(text: Column) -> Column:
    """White space, no-break spaces included, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\s ]+", " "))


def decode_entities(text: Column) -> Column:
    """Character references read in one pass: each token by itself, so what one gives is not read again."""
    tokens = F.regexp_extract_all(text, F.lit(r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def one(t: Column) -> Column:
        body = F.regexp_extract(t, r"^&([^;]+);$", 1)
        hexa = F.lower(F.substring(body, 2, 1)) == "x"
        digits = F.when(hexa, F.substr(body, F.lit(3))).otherwise(F.regexp_extract(body, r"^#([0-9]+)", 1))
        code = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        utf8 = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        named = names[F.lower(body)]
        return F.when(F.startswith(body, F.lit("#")), F.coalesce(utf8, t)).when(body != "", F.coalesce(named, t)).otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def clean_inline(html: Column) -> Column:
    """Tags to spaces, references read, white space collapsed, in this order."""
    return collapse(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))


def strip_chrome(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?is)<({'|'.join(CHROME)})\b[^>]*>.*?</\1>", " ")


def marked_lines(html: Column) -> Column:
    """Content with a line for each block, and headings as marked lines of level and title."""
    text = F.regexp_replace(strip_chrome(html), r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", f"\n{HEADING_MARK}$1{LEVEL_MARK}$2\n")
    return F.regexp_replace(text, rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n")


def html_text(html: Column) -> Column:
    return clean_inline(F.regexp_replace(marked_lines(html), f"{HEADING_MARK}[1-6]{LEVEL_MARK}", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_title(url: Column) -> Column:
    """Title of an encyclopedia path, or the last part of the path in words, or the host."""
    wiki = F.regexp_extract(path(url), r"^/wiki/(.+)$", 1)
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    last = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    words = F.trim(F.regexp_replace(decoded(F.when(last == "", host(url)).otherwise(last)), "[-_]", " "))
    is_wiki = host(url).rlike(r"(^|\.)wikipedia\.org$") & (wiki != "")
    return F.when(host(url) == "", url).when(is_wiki, F.trim(F.replace(decoded(wiki), F.lit("_"), F.lit(" ")))).otherwise(words)


def html_title(html: Column, url: Column) -> Column:
    raw = clean_inline(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    title = F.trim(F.regexp_extract(raw, "^([^|–—]*)", 1))
    return F.when(title != "", title).otherwise(url_title(url))


def page_sections(html: Column) -> Column:
    """The sections of a page in order as an array of level, title, content: the lead, then one for each heading that has a title and content."""

    def one(piece: Column, k: Column) -> Column:
        # all but the first begin with the level, its mark and the heading's line
        head = F.when(k == 0, F.lit("")).otherwise(F.substring_index(piece, "\n", 1))
        body = F.when(k == 0, piece).otherwise(F.substr(piece, F.length(head) + 2))
        lines = F.filter(F.transform(F.split(body, "\n"), clean_inline), lambda x: x != "")
        level = F.when(k == 0, F.lit(0)).otherwise(F.substring(head, 1, 1).try_cast("int")).cast("bigint")
        return F.struct(level.alias("level"), clean_inline(F.substr(head, F.lit(3))).alias("title"), F.array_join(lines, "\n").alias("content"))

    made = F.transform(F.split(marked_lines(html), HEADING_MARK), one)
    return F.filter(made, lambda s, k: (k == 0) | (s["title"] != "") & (s["content"] != ""))


def sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, section_index, level, title, content. Each page is taken apart inside its row, so nothing is shuffled."""
    made = pages.select(key, F.posexplode(page_sections(F.col(html))).alias("section_index", "s"))
    return made.select(key, F.col("section_index").cast("bigint").alias("section_index"), "s.level", "s.title", "s.content")


def categories(url: Column) -> Column:
    """Up to three labels from the path; none of an encyclopedia's."""
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda s: F.length(s) > 2), 1, 3)
    clean = F.filter(F.transform(parts, lambda s: collapse(F.regexp_replace(s, "[-_]", " "))), lambda s: (s != "") & ~F.lower(s).isin(*NO_CATEGORY))
    upper = lambda s: F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(host(url).rlike(r"(^|\.)wikipedia\.org$"), F.array().cast("array<string>")).otherwise(F.transform(clean, upper))


def _without_dots(url: Column) -> Column:
    """An absolute address with the path segments ``.`` and ``..`` resolved."""
    base = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    segments, rest = F.split(path(url), "/"), F.regexp_extract(url, r"(\?.*)$", 1)

    def step(kept: Column, s: Column) -> Column:
        # the first segment is the empty one before the leading slash, which stays
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(s == "..", up).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    walked = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
    full = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(path(url).rlike(r"/\.\.?(/|$)"), F.concat(base, F.array_join(full, "/"), rest)).otherwise(url)


def links(html: Column, url: Column) -> Column:
    """Absolute https links to the same host, fragments dropped, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    wanted = F.filter(F.transform(found, strip), lambda h: (h != "") & ~h.startswith("#") & ~F.lower(h).rlike("^(javascript|mailto|tel|data):"))

    def absolute(h: Column) -> Column:
        out = F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        out = out.when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(root, path(url), h)).otherwise(F.concat(root, folder, h))
        return _without_dots(F.regexp_replace(out, "#.*$", ""))

    same = F.filter(F.transform(wanted, absolute), lambda a: a.startswith("https:") & (host(a) == host(url)))
    return F.array_distinct(same)


def url_allowed(url: Column) -> Column:
    """https, a host, and no credentials."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return url.rlike("^(?i)https://") & (host(url) != "") & ~F.contains(authority, F.lit("@"))


def ipv4_blocked(ip: Column) -> Column:
    """Whether an IPv4 address is not public; what is no address is blocked."""
    valid = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    a, b, c = (F.regexp_extract(ip, r"^(\d+)\.(\d+)\.(\d+)", k).try_cast("int") for k in (1, 2, 3))
    rules = (
        a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    return ~valid | F.coalesce(rules, F.lit(True))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address in any of its spellings, null for anything else."""
    v4 = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    byte = lambda k: F.regexp_extract(ip, v4, k).try_cast("int")
    sound = F.coalesce(F.greatest(*[byte(k) for k in (2, 3, 4, 5)]) <= 255, F.lit(False))
    pair = lambda a, b: F.lower(F.hex(byte(a) * 256 + byte(b)))
    plain = F.when(~ip.rlike(v4), ip).when(sound, F.concat(F.regexp_extract(ip, v4, 1), pair(2, 3), F.lit(":"), pair(4, 5)))

    def side(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def whole(halves: Column) -> Column:
        left, right = side(F.get(halves, F.lit(0))), side(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        fits = ((F.size(halves) == 2) & (missing >= 1)) | ((F.size(halves) == 1) & (missing == 0))
        return F.when(fits & F.forall(filled, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(F.split(plain, "::", -1), whole)


def ip_blocked_column(ip: Column) -> Column:
    """Whether an address of either family is not public, with IPv4 inside IPv6 judged as IPv4; what is no address is blocked."""

    def six(g: Column) -> Column:
        at = lambda k: F.get(g, F.lit(k))
        zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        inner = F.concat_ws(".", *[f(at(k)).cast("int").cast("string") for k in (6, 7) for f in (lambda x: F.floor(x / 256), lambda x: x % 256)])
        carried = zeros(6) | (zeros(5) & (at(5) == 0xFFFF))
        # fe80::/10 and fec0::/10 are fe80 to feff
        reserved = at(0).between(0xFE80, 0xFEFF) | at(0).between(0xFC00, 0xFDFF) | (at(0) >= 0xFF00) | ((at(0) == 0x2001) & (at(1) == 0x0DB8))
        return F.when(carried, ipv4_blocked(inner)).otherwise(reserved)

    return F.when(F.contains(ip, F.lit(":")), F.coalesce(let(ipv6_groups(ip), six), F.lit(True))).otherwise(F.coalesce(ipv4_blocked(ip), F.lit(True)))


def ip_blocked(ip: str) -> bool:
    """The gate for one address of either family, with IPv4 inside IPv6 judged as IPv4."""
    import ipaddress

    try:
        x = ipaddress.ip_address(ip)
    except ValueError:
        return True
    if x.version == 4:
        a, b, c, _ = x.packed
        return a in (0, 10, 127) or a >= 224 or (a, b) in ((169, 254), (192, 168), (198, 18), (198, 19)) or (a == 172 and 16 <= b <= 31) or (a == 100 and 64 <= b <= 127) or (a, b, c) in ((192, 0, 0), (192, 0, 2), (198, 51, 100), (203, 0, 113))
    nets = ("::/128", "::1/128", "fe80::/10", "fec0::/10", "fc00::/7", "ff00::/8", "2001:db8::/32")
    if any(x in ipaddress.ip_network(n) for n in nets):
        return True
    if x.ipv4_mapped or int(x) < 1 << 32:
        return ip_blocked(str(ipaddress.IPv4Address(int(x) & 0xFFFFFFFF)))
    return False


def windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping windows of a trimmed text; the last one reaches its end."""
    if size < 1:
        raise ValueError("a window has at least one character")
    step = max(1, size - overlap)

    def cut(t: Column) -> Column:
        """Windows of a piece, each of which starts ``step`` after the last."""
        n = F.when(F.length(t) <= size, F.lit(1)).otherwise(F.ceil((F.length(t) - size) / step) + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(t, k * step + 1, F.lit(size)))

    # a place in a text is found by walking there, so a long text is first dealt into pieces of many windows each
    run = max(1, 65_536 // step)

    def dealt(t: Column) -> Column:
        whole = F.when(F.length(t) <= size, F.lit(1)).otherwise(F.ceil((F.length(t) - size) / step) + 1).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((whole - 1) / run).cast("int")), lambda p: F.substr(t, p * run * step + 1, F.lit((run - 1) * step + size)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(pieces, lambda p: let(p, cut))))

    return let(strip(text), dealt)


def relation(verb: Column) -> Column:
    """A relation verb in its usual form."""
    clean = F.regexp_replace(F.lower(strip(verb)), r"[\s-]+", "_")
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.when(clean.isin(*RELATIONS), clean).otherwise(F.coalesce(known[clean], clean))


def string_list(json: Column) -> Column:
    """The strings of a JSON array of nothing but strings; null for anything else."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.from_json(json, "array<string>"), lambda x: x.isNull()), F.lit(False)), F.from_json(json, "array<string>"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template whose ``{{name}}`` marks are replaced once, literally: what a value holds is not looked at again."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    made = [F.lit(x) if k % 2 == 0 else F.coalesce(values[x].cast("string"), F.lit("")) if x in values else F.lit("{{" + x + "}}") for k, x in enumerate(parts)]
    return F.concat(*made)


def lone_surrogate(json: Column) -> Column:
    """Whether a JSON text escapes half of a surrogate pair, which no UTF-8 text can hold."""
    escapes = F.replace(json, F.lit("\\\\"), F.lit(""))  # an escaped backslash begins no other escape
    pairs = F.regexp_replace(escapes, r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}", "")
    return pairs.rlike(r"(?i)\\ud[89a-f][0-9a-f]{2}")


def canonical_json(json: Column) -> Column:
    """A JSON text without white space and with the keys of each object in order; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


#: Keys that no parsed object may have; fixed values.
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")


def safe_json(json: Column) -> Column:
    """Canonical JSON, null if any object in it has a forbidden key."""
    clean = canonical_json(json)
    return F.when(~clean.rlike(r'[{,]"(' + "|".join(FORBIDDEN_KEYS) + r')":'), clean)


def real_date(text: Column) -> Column:
    """The date that a text of the form yyyy-mm-dd names, null if there is no such day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def tag_date(tag: Column) -> Column:
    """The real date in a tag."""
    return real_date(F.regexp_extract(tag, r"(?:^|\D)(\d{4}-\d{2}-\d{2})(?:\D|$)", 1))


def truncate(text: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def strip_fence(text: Column) -> Column:
    """A text without the fence lines around it; a text without an opening fence is only trimmed."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(clean, r"^```[^\n]*\n?", ""), r"\n?```[ \t]*$", "")
    return F.when(F.startswith(clean, F.lit("```")), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(clean)


def redact(text: Column, secrets: list[str]) -> Column:
    for s in sorted({s for s in secrets if s}, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    return text


def sse_frame(event: Column, data: Column) -> Column:
    """A server-sent event: one data line for each line of the data."""
    lines = F.transform(F.split(data, "\r\n|\r|\n"), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def wiki_url(title: Column) -> Column:
    """Address of an encyclopedia article."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), coded)


def cites(answer: Column, ident: Column) -> Column:
    """Place of the first mention of an identifier that no identifier character follows; 0 if there is none."""

    def first(pieces: Column) -> Column:
        # the mention before piece k+1 counts if that piece starts with something else
        free = F.filter(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: ~F.substring(F.get(pieces, k), 1, 1).rlike("[A-Za-z0-9_#]"))
        return F.when((F.size(pieces) < 2) | (F.size(free) == 0), F.lit(0)).otherwise(let(F.array_min(free), lambda k: place(pieces, k)))

    def place(pieces: Column, k: Column) -> Column:
        return F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, p: n + F.length(p)) + (k - 1) * F.length(ident) + 1

    return let(F.split(answer, F.concat(F.lit("\\Q"), ident, F.lit("\\E"))), first).cast("bigint")
