"""Plain text out of wiki markup, for the operators on documents. Linear passes over the whole text."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*/\s*>|<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref\s*>", re.S | re.I)
_BREAK = re.compile(r"<\s*(?:br|hr|p|div|li|td|tr|th)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTES = re.compile(r"'{2,}")
_INNER_TEMPLATE = re.compile(r"\{\{\{[^{}]*\}\}\}|\{\{([^{}]*)\}\}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_OUTER_LINK = re.compile(r"\[(?:https?:|ftp:|//)[^\s\[\]]*\s?([^\[\]]*)\]", re.I)
_URL = re.compile(r"\b(?:https?|ftp)://\S+", re.I)

#: A template argument with this many words is text, not a setting: a leaked stretch keeps that many of its 25.
TEXT_WORDS = 23

_NAMED = re.compile(r"\s*[\w -]{1,20}=")


def _template(m: re.Match) -> str:
    """The arguments of a template that are text, each on a line of its own."""
    texts = [x for x in (m.group(1) or "").split("|")[1:] if len(x.split()) >= TEXT_WORDS]
    return "".join("\n" + (x.partition("=")[2] if _NAMED.match(x) else x) + "\n" for x in texts)


def drop_templates(text: str) -> str:
    """Balanced templates away, innermost first, but for arguments that are text; unclosed ones keep their text."""
    while "{{" in text:
        text, n = _INNER_TEMPLATE.subn(_template, text)
        if not n:
            break
    return text


#: Link prefixes whose target is no part of the text.
HIDDEN = ("category:", "file:", "image:", "kategorie:", "catégorie:", "categoría:", "categoria:", "categorie:", "категория:", "файл:", "datei:", "fichier:", "archivo:", "ficheiro:", "bestand:")


def _link(m: re.Match) -> str:
    inside = m.group(1)
    if inside.lstrip(" :").lower().startswith(HIDDEN) and not inside.lstrip().startswith(":"):
        return ""
    return inside.rpartition("|")[2]


def drop_links(text: str) -> str:
    while "[[" in text:
        text, n = _LINK.subn(_link, text)
        if not n:
            break
    return _OUTER_LINK.sub(r"\1", text)


def inline(text: str) -> str:
    """Markup inside lines away: comments, references, templates, links, tags, quotes, entities. Line breaks stay."""
    if "<" in text:
        text = _COMMENT.sub("", text)
        text = _REF.sub("", text)
    text = drop_links(drop_templates(text))
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text
