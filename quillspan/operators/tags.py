"""What the parser and the renderers know about tags; fixed values, as sets of names."""

from __future__ import annotations


def _set(*names: str) -> frozenset[str]:
    return frozenset(names)


VOID = _set(
    "meta", "br", "hr", "img", "link", "area", "base", "col", "embed", "input", "keygen", "param", "source", "track", "wbr",
)
RAW_TEXT = _set(
    "title", "script", "style", "textarea", "iframe", "noscript", "noembed", "noframes", "datalist", "xmp", "plaintext",
)
#: Without any output in Markdown and text.
SILENT = _set("title", "script", "style", "template", "iframe", "noscript", "noembed", "noframes", "datalist")
IN_HEAD = _set("title", "meta", "link", "base", "style", "script", "noscript", "template")
HEADINGS = _set("h1", "h2", "h3", "h4", "h5", "h6")
#: Blocks with a blank line before and after.
SPACED = _set(
    "blockquote", "ul", "table", "ol", "pre", "p", "div", "nav", "article", "section", "figure", "main", "header", "caption", "html", "details",
    "summary", "hr",
) | HEADINGS
#: Blocks without spacing of their own: their children pass through.
PASSING = _set(
    "form", "body", "center", "footer", "svg", "select", "option", "fieldset", "legend", "audio", "video", "canvas", "map", "dialog", "meter",
    "progress", "aside", "dl", "optgroup", "tbody", "thead", "tfoot", "td", "th", "tr", "address", "dd", "dt", "li", "head",
)
CLOSES_P = _set(
    "div", "p", "ul", "ol", "li", "dl", "dd", "dt", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "header",
    "footer", "nav", "aside", "pre", "hr", "form", "fieldset", "figure", "figcaption", "address", "main", "center", "details", "summary",
    "dialog",
)
P_SCOPE = _set("button", "td", "th", "caption", "table", "template", "html", "ul", "ol", "dl", "li")
LI_SCOPE = _set("ul", "ol", "table", "td", "th", "caption", "template", "html")
DL_SCOPE = _set("dl", "ul", "ol", "li", "table", "td", "th", "caption", "template", "html")
CELL_SCOPE = _set("tr", "thead", "tbody", "tfoot", "table", "caption", "template", "html")
ROW_SCOPE = _set("thead", "tbody", "tfoot", "table", "template", "html")
SECTION_SCOPE = _set("table", "template", "html")
A_SCOPE = (CLOSES_P - {"center", "details", "summary", "dialog"}) | _set("td", "th", "tr", "caption", "button", "template", "html")
#: Kept as HTML in Markdown.
LITERAL = _set("details", "summary", "address", "dl", "dt", "dd")
KEPT_INLINE = _set("sub", "sup", "ins", "u", "mark")
BACKTICKED = _set("kbd", "samp", "var")
#: Elements of safe HTML and what they are written as.
SAFE = {t: t for t in (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "code", "strong", "em", "del", "a", "img", "br", "hr",
    "table", "thead", "tbody", "tfoot", "tr", "th", "td", "caption", "figure", "figcaption", "dl", "dt", "dd", "details", "summary", "sub",
    "sup", "mark", "ins", "u", "kbd", "samp", "var", "q", "cite", "dfn", "abbr", "small",
)} | {"b": "strong", "i": "em", "s": "del", "strike": "del"}
#: What the minimal preset leaves out.
MINIMAL_EXCLUDED = _set(
    "form", "fieldset", "object", "embed", "footer", "aside", "iframe", "input", "textarea", "button", "select", "nav",
)
