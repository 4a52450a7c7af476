"""HTML to text: as column expressions, and strictly by the standard parser."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: References that are decoded by replacement, the ampersand last.
SIMPLE = {"nbsp": "\xa0", "copy": "©", "reg": "®", "deg": "°", "middot": "·", "quot": '"', "apos": "'", "#39": "'", "lt": "<", "gt": ">", "amp": "&"}
#: White space as Python's str methods know it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: What the queries' SQL decodes, in its order; its ``\s``, and what it squeezes and trims.
PLAIN = (("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&amp", "&"))
PLAIN_S = r"[\t\n\f\r ]"
PLAIN_SPACE = r"[\t-\r\x1c-\x1f \x85\xa0]+"
SEPARATORS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def any_case(word: str) -> str:
    """A pattern of a word in any case, as DuckDB folds it: a long s is an s, but a dotless i is no i."""
    fold = {"s": "\u017f", "k": "\u212a"}
    return "".join(f"[{c}{c.upper()}{fold.get(c, '')}]" if c.isascii() and c.isalpha() else re.escape(c) for c in word.lower())


def clean_html(html: Column, strip_tags: tuple[str, ...], plain: bool = False) -> Column:
    """Text outside the stripped elements, a space between text nodes.

    Most pages are read by built-in functions alone. Where these would not give what a parser does
    (``_is_hard``), the page goes through ``clean_html_strict``; of all others the function sees a null.
    ``plain`` reads every page as the SQL of q02 does, by replacement alone: a reference that PLAIN lacks stays as it is written.
    """
    if plain:
        return _clean_plain(html, strip_tags)
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<![A-Za-z][^>]*>", " ")
    tags = "|".join(map(re.escape, strip_tags))
    if tags:
        bare = F.regexp_replace(bare, rf"(?is)<({tags})(?=[\s>/])[^>]*>.*?</\1\s*>", " ")
    hard = _is_hard(html, bare, tags)
    text = F.regexp_replace(bare, r"<[A-Za-z/][^>]*>", " ")
    for name, char in SIMPLE.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.when(hard, clean_html_strict(strip_tags)(F.when(hard, html))).otherwise(squeeze(text))


def _clean_plain(html: Column, strip_tags: tuple[str, ...]) -> Column:
    text = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    text = F.regexp_replace(text, r"<![A-Za-z][^>]*>", " ")
    for tag in map(any_case, strip_tags):
        text = F.regexp_replace(text, rf"(?s)<{tag}(?:(?:{PLAIN_S}|/)[^>]*)?>.*?(?:</{tag}{PLAIN_S}*>|\z)", " ")
    text = F.regexp_replace(text, r"<[A-Za-z/][^>]*>", " ")
    for name, char in PLAIN:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(text, PLAIN_SPACE, " "), F.lit(SEPARATORS))


def _is_hard(html: Column, bare: Column, tags: str) -> Column:
    """Does a page hold what replacement does not read as a parser does?

    Other references, or any without its semicolon; a ``>`` or ``<`` inside a quoted attribute; a comment or tag without its
    end, or markup that is neither; a stripped element inside one of its name, never closed or never opened; raw text outside a stripped one.
    """
    names = "|".join(SIMPLE)
    odd = html.rlike(rf"&(?!(?:{names});)[#A-Za-z]") | html.rlike("=\\s*(?:\"[^\"<>]*[<>]|'[^'<>]*[<>])") | html.rlike(r"<!-->|<!--->|--!>|<!\[|<\?|</[^A-Za-z]")
    raw = [t for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes") if t not in tags.split("|")]
    odd = odd | bare.rlike(r"<!|<[^>]*\z") | bare.rlike(rf"(?is)<({'|'.join(raw)})(?=[\s>/])[^>]*>[^<]*<(?!/\1\s*>)") | bare.rlike("(?i)<(?:plaintext|svg|math)")
    return (odd | bare.rlike(rf"(?i)</?(?:{tags})[\s>/]")) if tags else odd


class PageReader(HTMLParser):
    """Text nodes outside the stripped elements.

    An end tag closes the innermost open element of its name with all inside it, and nothing if there
    is none; an element that is never closed ends with what is around it.
    """

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, strip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.strip, self.parts, self.open = strip, [], []
        self.count, self.hidden = Counter(), 0

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.open.append(tag)
            self.count[tag] += 1
            self.hidden += tag in self.strip

    def handle_endtag(self, tag):
        while self.count[tag]:
            last = self.open.pop()
            self.count[last] -= 1
            self.hidden -= last in self.strip
            if last == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def read_html(html: str | None, strip_tags: tuple[str, ...]) -> str | None:
    if html is None:
        return None
    reader = PageReader(frozenset(strip_tags))
    reader.feed(html)
    reader.close()
    return " ".join(" ".join(reader.parts).split())


#: Pages that are Python strings at once.
FEW = 64


def clean_html_strict(strip_tags: tuple[str, ...]):
    """The same by the standard library's parser, over Arrow batches, of which only a few pages are Python strings at a time."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([read_html(h, strip_tags) for h in batch.slice(at, FEW).to_pylist()], pa.string()) for at in range(0, len(batch), FEW)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return clean
