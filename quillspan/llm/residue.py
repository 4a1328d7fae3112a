"""Problem 3: template residue and error-page text.

Method: records of one template are aligned by what their lines share, and what stands where
they differ is a slot. Three alignments give the rows; each row tells its reason:

* ``slot``: a delimited name (``{{x}}``, ``%x%``, ``[[x]]`` ...) keys its line with a gap in its place, coined
  words and digits masked. It is a retained variable name where records of that key hold different
  values, where the same name stands in different templates (of marks that only templating languages
  use), or where filled lines of other pages fit the key. Defaults ("your … here") and blanks are
  compared with filled lines in the same way. Filled lines meet keys by the hash of their first or
  last characters, then the whole key decides: a mark among at least ``LONG_CONTEXT`` words needs
  one line that holds something else, marks with less around them, defaults and blanks two different
  ones on two pages. A blank must show: a space before a comma or full stop, a separator at the end
  or the beginning, empty brackets or quotes (not in a text with inline code, where the code may be
  what is missing). A line from which a word is missing without a trace is none.
* ``template``: the whole main text, digits and codes masked, recurs on ``MIN_SITES`` sites under ``MIN_TITLES``
  titles. Of a text of more than ``SHORT_CHARS`` a title of which half the words stand in the text is
  its own and doesn't count, so that articles republished under their titles stay.
* ``sentence``: at least half of the main text are sentences of such whole-page templates.

What too few records show is confirmed from the single row: ``syntax`` (marks of templating languages)
and ``wording`` (main texts of sentences known from error pages, demands for scripts, browser checks and
filler). :func:`reasons` reports the rows by reason.

The main text is the subtree of highest text density (``page_text``) without page furniture,
remarks and code, so a real article that mentions such things or shows them as code, and its
notice for browsers without scripts, don't count.

Defined results
---------------
* null and empty titles and html (pages served as Markdown) say nothing; only what is there counts.
* a page counts once, however often it is repeated; null ``page_id`` gives no row.
* html without text is no error page; very long texts are read whole.
* extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.sites import site_of
from quillspan.llm.folding import fold, pattern_form
from quillspan.llm.furniture import REMARK, normal
from quillspan.llm.main_text import _signed
from quillspan.llm.page_text import Page
from quillspan.plans.tables import materialize, spread, table

#: Why a page is left out, the strongest first.
REASONS = ("slot", "template", "sentence", "syntax", "wording")
MIN_SITES = 3
MIN_TITLES = 3
#: Up to here a text counts as a template under any titles.
SHORT_CHARS = 600

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
#: Marks that only templating languages use.
STRONG = re.compile(
    rf"\{{\{{\{{?\s*[#/^>&!]?\s*{_NAME}[^{{}}\n]{{0,60}}\}}\}}\}}?"
    rf"|\{{%-?\s*{_NAME}[^{{}}\n]{{0,80}}%\}}|\[%-?\s*{_NAME}[^\[\]\n]{{0,80}}%\]"
    rf"|<%[=\-#]?\s*{_NAME}[^<>\n]{{0,80}}%>|<\?(?:=|php\b)\s*\$?{_NAME}[^<>\n]{{0,80}}\?>"
    rf"|[$#]\{{\s*{_NAME}\s*\}}|\{{\${_NAME}\}}|%%{_NAME}%%|@@{_NAME}@@"
    r"|\bTODO[_ ]REPLACE[_ ]\w+|\bREPLACE[_ ]ME\b"
    r"|\[INSERT [^\[\]\n]{1,60}\]|\[(?:your|enter|add) [^\[\]\n]{1,60}\]|<(?:Your|Enter|Insert) [^<>\n]{1,60}>",
)
#: Marks that may mean something else; what their template's other records hold decides.
WEAK = re.compile(
    rf"\[\[\s*{_NAME}\s*\]\]|\(\(\s*{_NAME}\s*\)\)|(?<![\w%])%{_NAME}%(?![\w%])|(?<!\w)__[A-Za-z][A-Za-z0-9_.]*__(?!\w)|\{{\s*(?:\d{{1,2}}|{_NAME})\s*\}}|\[\s*[A-Z]+(?:_[A-Z]+)+\s*\]"
)
#: What every mark holds; the costly patterns run only where one of these stands.
_HINT = re.compile(r"[{%@\[<_]|\(\(|[$#]\{|TODO|REPLACE")
#: Defaults that templates are delivered with.
DEFAULT = re.compile(r"\byour (?:[\w’'-]+ ){1,4}(?:goes )?here\b|\buntitled\b", re.I)
#: Places where something seems to be missing.
BLANK = re.compile(r"(?<=\w )(?=[,.](?:\s|$))|(?<= [-–—|·])$|^(?=[-–—|·] )|(?<=\s[(“«\"])\s*(?=[)”»\"](?!\w))")
#: Where defaults and blanks may stand, for the same reason as ``_HINT``.
_DEFAULT_HINT = re.compile(r"here|HERE|Here|ntitled|NTITLED")
_OPEN_END = "-–—|·"
_EMPTY = re.compile(r"[(“«\"]\s*[)”»\"]")
LONG_CONTEXT = 3
#: Lengths of the parts of lines by which they are brought together with patterns.
ANCHORS = (24, 8, 2)
#: Slots of the sketch of patterns, which goes with the tasks (two of 128 KB at any size of the data).
KEY_SLOTS = 1 << 20
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]{2}|\w+")
_VARIABLE = re.compile(r"[._]|^[A-Z]+$|^\d+$")
# the patterns begin with a class of characters, which the regular expression engine looks for much faster than for an assertion
_COINED = re.compile(r"[A-Z](?<!\w[A-Z])[\w’-]*")
_HEX = re.compile(r"[0-9a-f](?<!\w[0-9a-f])(?:(?<=\d)|(?=[0-9a-f]*\d))[0-9a-f]{5,}\b")
#: What stands in every word that ``_HEX`` finds, but those of digits alone.
_HEX_PAIR = re.compile(r"\d(?:(?<=[a-f]\d)|[a-f])")
_DIGITS = re.compile(r"\d\d*")
#: The end of a sentence with the space after it; lines stay apart.
_END = re.compile(r"([.!?…。！？])(?:(?<=[.!?…])[^\S\n]+|(?<=[。！？])[^\S\n]*)")
_LATIN = re.compile(r"[a-z]+")
_REFERENCE = re.compile(
    pattern_form(r"(?:reference|incident|ray|event id|code|kennung|código|référence|код|stack|trace|request id|error code|番号|識別番号|参照)(?:\W.{0,60})?$")
)

#: How sentences of such pages begin, in lower case: error messages, refusals, script demands, browser checks.
ERROR = (
    r"(?:the |this )?(?:page|address|url|file|resource|content) (?:you (?:requested|were looking for|tried)|requested|could not be|cannot be|is no longer|was not|does not exist|is gone|not found)",
    r"oops\b", r"nothing (?:lives|was found|here)\b", r"it may have (?:moved|been)\b", r"something went wrong\b",
    r"an? (?:unexpected |internal )?error (?:has )?occurred\b", r"(?:\d{3} ?)?(?:not found|forbidden|bad gateway|internal (?:server )?error|service unavailable|access denied|page not found|session expired|too many requests)\b",
    r"(?:fatal|uncaught|unhandled|exception|warning|stack|error)\s?[:(]", r"could not connect\b", r"bad gateway\b", r"the (?:upstream|application|request|team|database|connection|gateway|requested)\b",
    r"(?:the|this) (?:server|service|site) (?:cannot|could not|is (?:temporarily|currently|not)|is under)\b",
    r"you do not have (?:permission|access)\b", r"your (?:request|address|session|account|connection) (?:was|sent|has|is|could)\b", r"you have sent \d+ requests\b",
    r"access (?:is|to this|has been)\b", r"(?:please )?(?:try (?:again|the search)|sign in again|wait a moment|contact the)\b",
    r"please reload\b", r"(?:return to|go back to|use the search|check the spelling|tell the owner)\b", r"this content is no longer\b", r"this page is gone\b",
    r"die angeforderte\b", r"(?:seite|datei) nicht gefunden\b", r"sie haben keine berechtigung\b", r"zugriff verweigert\b", r"beim verarbeiten ihrer anfrage\b", r"der (?:dienst|server) ist\b", r"fehler \d+", r"(?:bitte )?versuchen sie es\b", r"ihre (?:sitzung|anfrage) (?:ist|wurde)\b", r"prüfen sie die\b",
    r"la page (?:demandée|que vous)\b", r"page introuvable\b", r"vous n’(?:êtes pas autorisé|avez pas)\b", r"le (?:service|serveur) (?:est|n)\b", r"erreur \d+", r"réessayez\b", r"une erreur (?:est|s’est)\b", r"accès refusé\b", r"votre (?:session|demande)\b",
    r"la página (?:solicitada|que)\b", r"página no encontrada\b", r"no tiene permiso\b", r"se produjo un (?:problema|error)\b", r"el (?:servicio|servidor) no\b", r"acceso denegado\b", r"error \d+", r"vuelva a intentarlo\b", r"inténtelo\b", r"su (?:sesión|solicitud)\b",
    r"запрошенная страница\b", r"страница не найдена\b", r"(?:сервер|сервис) временно\b", r"повторите попытку\b", r"ошибка \d+", r"у вас нет (?:прав|доступа)\b", r"доступ (?:запрещ|закрыт)", r"произошла ошибка\b", r"при обработке\b", r"вы не имеете\b",
    r"お探しのページ", r"ページが見つかりません", r"アクセスできません", r"ただいまサーバー", r"エラーが発生", r"このページを(?:表示|閲覧)する権限", r"権限がありません", r"\d+分後に", r"後でもう一度",
)
SCRIPTS = (
    r"(?:please )?(?:enable|activate|allow|turn on|switch on) (?:scripts?|scripting|javascript|cookies)\b",
    r"(?:this|the) (?:site|page|application|app|viewer|website) (?:requires?|needs?|cannot be shown|does not work|will not work)\b.{0,80}(?:script|javascript|cookie)",
    r"your browser (?:does not|has|is)\b", r"you need to (?:turn on|enable|activate|allow)\b", r"for full functionality\b",
    r"checking your browser\b", r"this takes a few seconds\b", r"scripts and cookies must\b", r"verify (?:that )?you are (?:a )?human\b", r"this step needs\b", r"loading(?:…|\.\.\.)", r"if nothing happens\b", r"javascript\b.{0,60}(?:required|disabled|off|needed)",
    r"bitte aktivieren sie (?:javascript|skripte|cookies)\b", r"diese (?:anwendung|seite) benötigt\b.{0,40}(?:skript|javascript)", r"ihr browser hat\b", r"ihr browser wird\b",
    r"veuillez activer\b", r"cette (?:application|page) a besoin\b", r"activez (?:javascript|les scripts)\b",
    r"active javascript\b", r"esta (?:aplicación|página) necesita\b.{0,40}(?:script|javascript)", r"habilite\b.{0,20}javascript",
    r"для работы (?:сайта|страницы)\b", r"приложению нужны\b", r"включите (?:javascript|сценарии)\b",
    r"このサイトを表示するには", r"スクリプトが無効", r"javascriptを有効",
)
FILLER = (
    r"your text goes here\b", r"replace this paragraph\b", r"this is a placeholder\b", r"click to edit\b", r"dummy (?:copy|text)\b", r"sample (?:heading|text)\b", r"headline (?:one|two|three|four|\d)\b", r"add a short description\b", r"put your message here\b", r"edit this section\b", r"change me\b", r"this block is\b", r"(?:put|write|insert|enter|add|type) (?:a|an|the|your) .{1,40} here\b", r"lorem ipsum\b",
    r"platzhalter für\b", r"hier steht ein\b", r"bitte ersetzen sie diesen\b", r"blindtext\b",
    r"texte (?:fictif|provisoire|factice)?\s?à remplacer\b", r"texte \w+ à remplacer\b", r"insérez votre texte\b", r"ce paragraphe est un exemple\b",
    r"texto de (?:relleno|ejemplo|muestra)\b", r"escriba aquí su texto\b", r"este párrafo es un ejemplo\b",
    r"здесь будет ваш\b", r"замените этот абзац\b", r"образец текста\b",
    r"仮のテキスト", r"ここに文章を入力", r"これは見本",
)
_BAD = re.compile(pattern_form("|".join(f"(?:{p})" for p in (*ERROR, *SCRIPTS, *FILLER))))
#: Words of the customary Latin filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna"
    " aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split()
)


def _is_filler_latin(text: str) -> bool:
    words = _LATIN.findall(text)
    return len(words) >= 4 and sum(map(LOREM.__contains__, words)) >= 0.7 * len(words)


def bad_share(sentences: list[str], texts: list[str]) -> float:
    """The share of the characters that stand in sentences of error pages, script demands or filler; both in one form."""
    bad = other = 0
    half = sum(map(len, sentences)) / 2
    # a text of filler has three of its words at least
    if sum(map(LOREM.__contains__, _LATIN.findall("\n".join(texts)))) > 2 and any(map(_is_filler_latin, texts)):
        sentences = [s for s in _apart("\n".join(x for x in texts if not _is_filler_latin(x))).split("\n") if s]
        bad = sum(len(x) for x in texts if _is_filler_latin(x))
    for s in sentences:
        if _REFERENCE.match(s):
            continue
        if _BAD.match(s):
            bad += len(s)
        else:
            other += len(s)
            if other > half and other > bad:  # the rest can't make up for it
                rest = half * 2 - other - bad
                if bad + rest < other:
                    return 0.0
    return bad / (bad + other) if bad else 0.0


def _masked(text: str) -> str:
    return _DIGITS.sub("0", _HEX.sub("0", text) if _HEX_PAIR.search(text) else text)


def slots(line: str) -> list[tuple[str, str, bool]]:
    """(template, value, whether only templating languages use such a mark) of each mark in a line."""
    found = [(m, True) for m in STRONG.finditer(line)]
    found += [(m, False) for m in WEAK.finditer(line) if not any(n.start() < m.end() and m.start() < n.end() for n, _ in found)]
    return [
        (
            _coined(STRONG.sub("\0", line[: m.start()])) + "\0" + _coined(STRONG.sub("\0", line[m.end() :])),
            "".join(m[0].split()),
            strong,
        )
        for m, strong in found
    ]


def _titled(title: str | None, text: str) -> bool:
    """Whether at least half the words of a title stand in the text (in its form for matching)."""
    words = _WORD.findall(_masked(normal(title or "")))
    return bool(words) and 2 * sum(w in text for w in words) >= len(words)


def _coined(line: str) -> str:
    return _DIGITS.sub("0", _COINED.sub("N", line))


def _key(place: int, anchor: str) -> int:
    return _signed(f"{place} {anchor}")


def _ends(two: str) -> int:
    """An even slot of the sketch for two characters; for those at the end of a line the next one is taken."""
    return (ord(two[0]) * 8191 + ord(two[1])) * 2 % KEY_SLOTS


def _pattern(line: str, gaps: list[tuple[int, int]], least: int | None) -> dict | None:
    """The line as a pattern that has anything in its gaps; None where the fixed parts are too short to meet other lines."""
    parts, at = [], 0
    for start, stop in sorted(gaps):
        if start >= at:
            parts.append(line[at:start])
            at = stop
    parts.append(line[at:])
    if len(parts[0]) == len(line) and parts[0]:
        parts[0] += " "
    if len(parts[-1]) == len(line) and parts[-1]:
        parts[-1] = " " + parts[-1]
    parts = [_coined(x) for x in parts]
    side = 1 if len(parts[0]) >= len(parts[-1]) else -1
    outer = parts[0] if side > 0 else parts[-1]
    size = next((n for n in ANCHORS if n <= len(outer)), 0)
    if not size:
        return None
    if least is None:
        least = 1 if sum(len(_WORD.findall(x)) for x in parts) >= LONG_CONTEXT else 2
    quoted = ["\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" if x else "" for x in parts]
    anchor = outer[:size] if side > 0 else outer[-size:]
    return {
        "key": _key(side * size, anchor), "ends": _ends(anchor[:2]) if side > 0 else _ends(anchor[-2:]) ^ 1,
        "pattern": "^" + ".+".join(quoted) + "$", "own": _coined(line), "least": least,
    }


def patterns(line: str, shown: bool = True) -> list[dict]:
    """What other lines are compared with: the line without its marks, and, as it is shown, without its defaults and blanks."""
    marks = [m.span() for m in WEAK.finditer(line)] if _HINT.search(line) else []
    empty = [m.span() for m in DEFAULT.finditer(line)] if _DEFAULT_HINT.search(line) else []
    if shown and (" ," in line or " ." in line or line[0] in _OPEN_END or line[-1] in _OPEN_END or _EMPTY.search(line)):
        empty += [m.span() for m in BLANK.finditer(line)]
    out = [_pattern(line, marks, None)] if marks else []
    if empty:
        out.append(_pattern(line, marks + empty, 2))
    return [x for x in out if x]


_PATTERN = "struct<key: bigint, ends: int, pattern: string, own: string, least: int>"
_SCHEMA = (
    "page_id bigint, site bigint, title bigint, syntax boolean, wording boolean, whole bigint, own_title boolean,"
    " sentences array<bigint>, sizes array<int>, templates array<bigint>, names array<bigint>, text string,"
    f" patterns array<{_PATTERN}>"
)
_LONGS = pa.list_(pa.int64())
_ARROW = [
    pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), _LONGS, pa.list_(pa.int32()), _LONGS, _LONGS, pa.string(),
    pa.list_(pa.struct([("key", pa.int64()), ("ends", pa.int32()), ("pattern", pa.string()), ("own", pa.string()), ("least", pa.int32())])),
]
_NAMES = [x.split()[0] for x in _SCHEMA.replace("struct<key: bigint, ends: int, pattern: string, own: string, least: int>", "x").split(", ")]
#: One of these stands in each text that ``_HINT`` finds something in.
_HINTS = ("{", "%", "@", "[", "<", "_", "((", "TODO", "REPLACE")
#: How defaults begin.
_YOURS = re.compile("[yYuU](?:[oO][uU][rR] |(?i:ntitled))")
#: Where lines begin and end with what a blank leaves.
_OPEN_ENDS = tuple(x for c in _OPEN_END for x in (f"\n{c}", f"{c}\n"))


def _seems_missing(apart: str) -> bool:
    """Whether defaults or blanks may stand in a text of a sentence a line; most texts have none and are not taken apart."""
    return (
        (_YOURS.search(apart) is not None and _DEFAULT_HINT.search(apart) is not None) or " ," in apart or " ." in apart or apart[:1] in _OPEN_END or apart[-1:] in _OPEN_END or any(x in apart for x in _OPEN_ENDS)
        or _EMPTY.search(apart) is not None
    )


def _apart(text: str) -> str:
    """The text, a block a line, with a line for each sentence."""
    return _END.sub(r"\1\n", text)


def _lines(text: str) -> dict[str, None]:
    """The lines of a text but empty ones, each once, in order."""
    lines = dict.fromkeys(text.split("\n"))
    lines.pop("", None)
    return lines


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _scan_page(title: str | None, html: str | None) -> tuple:
    """What one page shows by itself, from ``syntax`` on in the order of ``_SCHEMA``."""
    running = [fold(_one_line(title))] if title and title.strip() else []
    with_code: list[str] = []
    less: list[str] = []
    head = ""
    whole: list[str] = []
    if html and html.strip():
        page = Page(html)
        inside = page.main()
        for (text, at, kind, outside), worded, folded, form in zip(page.blocks, page.furniture, page.folded, page.forms, strict=True):
            if at not in inside or kind == "pre":
                continue
            if outside is text or (outside := _one_line(outside)) == text:
                running.append(folded)
            else:
                running.append(fold(outside))
                if outside.replace(" ", "") != text.replace(" ", ""):
                    with_code.append(text)
                    less.append(outside)
            if worded or REMARK.match(form):
                continue
            if kind == "h1":
                head = form
            else:
                whole.append(form)
    shown = "\n".join(running)
    coded = fold("\n".join(with_code)) if with_code else ""
    syntax = False
    marks: dict[tuple[int, int], None] = {}  # each template and name of the page once
    gaps: list[dict] = []
    apart = _apart(shown)
    hinted, missing = any(x in shown for x in _HINTS), _seems_missing(apart)
    if hinted or missing:
        plain = _lines(apart)
        if hinted:
            for x in plain:
                if _HINT.search(x):
                    for template, name, strong in slots(x):
                        syntax = syntax or strong or bool(_VARIABLE.search(name.strip("[](){}%_"))) or not template.strip("\0 .,:;!?|–-")
                        marks[_signed(template), _signed(name)] = None
        if not syntax and (missing or marks):
            # what code leaves empty in the running text is no blank
            beside_code = set(_lines(_apart(fold("\n".join(less))))).difference(_lines(_apart(coded))) if less else ()
            gaps = [y for x in plain for y in patterns(x, not coded or x not in beside_code)]
    key, own_title, wording = None, False, False
    parts: list[str] = []
    if whole:
        text = "\n".join(whole)
        given = [s for s in _apart(text).split("\n") if s]
        wording = bad_share(given, whole) >= 0.5
        parts = list(dict.fromkeys(_masked("\n".join(given)).split("\n")))
        key = _signed("\n".join(sorted(parts)))
        own_title = len(text) > SHORT_CHARS and _titled(title, f"{text}\n{head}")
    elif head and html:
        wording = bool(_BAD.match(head))
    return (
        syntax, wording, key, own_title, [_signed(x) for x in parts], [len(x) for x in parts],
        [t for t, _ in marks], [n for _, n in marks], f"{apart}\n{_apart(coded)}" if coded else apart, gaps,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
        columns = zip(*(_scan_page(title, html) for title, html in pages), strict=True) if batch.num_rows else [[]] * 10
        made = [pa.array(x, k) for x, k in zip(columns, _ARROW[3:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], _NAMES)


def _lines_near(ends: bytes, keys: bytes):
    """Lines (sentences) of ``(page_id, text)`` that meet a pattern by their first or last characters: two sketches, of two characters and of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 14)(lambda two, end: _has(ends, _ends(two) ^ end))
        backwards = tuple(-n for n in ANCHORS)
        for batch in batches:
            rows = []
            for page_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = list(_lines(text))
                if not raw:
                    continue
                for line, own in zip(_coined("\n".join(raw)).split("\n"), raw, strict=True):
                    if len(line) < 2:
                        continue
                    places = ANCHORS if known(line[:2], 0) else ()
                    if known(line[-2:], 1):
                        places += backwards
                    for n in places:
                        if len(line) >= abs(n):
                            k = _key(n, line[:n] if n > 0 else line[n:])
                            if _has(keys, k % KEY_SLOTS):
                                rows.append((page_id, _signed(own), line, k))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["page_id", "raw", "line", "key"])

    return run


def _has(sketch: bytes, at: int) -> int:
    return sketch[at >> 3] >> (at & 7) & 1


def _sketch(slots_set: DataFrame) -> bytes:
    """A bit a slot; there are ``KEY_SLOTS`` at most, whatever the size of the data."""
    out = bytearray(KEY_SLOTS >> 3)
    for (n,) in slots_set.distinct().toLocalIterator():
        out[n >> 3] |= 1 << (n & 7)
    return bytes(out)


def _held_otherwise(keyed: DataFrame) -> DataFrame:
    """``(page_id)``: pages with a mark, a default or a blank where other lines of the pattern hold something else.

    Lines and patterns meet by the hash of a line's first or last characters; then the pattern decides.
    Lines that meet none drop out before, by a sketch of the patterns' hashes; equal lines are combined
    on the map side, so that a line repeated over a site is one row of the join.
    """
    given = keyed.where("NOT syntax AND NOT wording AND size(patterns) > 0").select("page_id", F.explode("patterns").alias("x"))
    given = materialize(given.select("page_id", "x.*", F.xxhash64("x.pattern", "x.own", "x.least").alias("id")), "patterns")
    distinct = given.select("id", "key", "pattern", "own", "least").dropDuplicates(["id"])
    keys = _sketch(given.select(F.pmod("key", F.lit(KEY_SLOTS)).cast("int")))
    if not any(keys):
        return given.select("page_id")
    ends = _sketch(given.select("ends"))
    near = keyed.where("text <> ''").select("page_id", "text").mapInArrow(_lines_near(ends, keys), "page_id bigint, raw bigint, line string, key bigint")
    once = near.groupBy("key", "line").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.min("page_id").alias("p"), F.max("page_id").alias("q"))
    met = once.join(distinct, "key").where("line <> own AND line RLIKE pattern")
    held = met.groupBy("id", "least").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("p").alias("p"), F.max("q").alias("q"))
    varied = held.where("least = 1 OR (a <> b AND p <> q)").select("id")
    return given.join(varied, "id", "left_semi").select("page_id")


def residue_pages(pages: DataFrame, min_sites: int = MIN_SITES, min_titles: int = MIN_TITLES) -> DataFrame:
    """``(page_id, reason)``: the pages to leave out, each once, with the strongest reason."""
    given = pages.where("page_id IS NOT NULL").select(
        "page_id", F.xxhash64(site_of(F.col("origin"), F.col("url"))).alias("site"), F.xxhash64("title").alias("__title"), "title", "html"
    )
    keyed = materialize(spread(given).mapInArrow(_scan, _SCHEMA), "residue")

    def because(df: DataFrame, reason: str) -> DataFrame:
        return df.select("page_id", F.lit(REASONS.index(reason)).alias("reason"))

    # slots that retain a name
    marks = keyed.where("size(templates) > 0").select("page_id", "syntax", F.explode(F.arrays_zip("templates", "names")).alias("x"))
    marks = marks.select("page_id", "syntax", F.col("x.templates").alias("template"), F.col("x.names").alias("name"))
    differ = lambda c: F.min(c) != F.max(c)
    varied = marks.groupBy("template").agg(differ("name").alias("varied")).where("varied").select("template")
    named = marks.where("syntax").groupBy("name").agg((differ("template") & differ("page_id")).alias("varied")).where("varied").select("name")
    slot = marks.join(varied, "template", "left_semi").select("page_id")
    slot = slot.union(marks.where("syntax").join(named, "name", "left_semi").select("page_id")).union(_held_otherwise(keyed))

    # main texts that recur over sites and titles, and texts made of their sentences
    one = keyed.where("whole IS NOT NULL AND NOT own_title").groupBy("whole", "site", "title").agg(F.lit(1).alias("one"))
    common = (
        one.groupBy("whole")
        .agg(F.count_distinct("site").alias("sites"), F.count_distinct("title").alias("titles"))
        .where((F.col("sites") >= min_sites) & (F.col("titles") >= min_titles))
        .select("whole")
    )
    template = keyed.join(common, "whole", "left_semi").select("page_id", "sentences")
    template = materialize(template, "templates")
    known = template.select(F.explode("sentences").alias("sentence")).distinct()
    sized = keyed.select("page_id", F.explode(F.arrays_zip("sentences", "sizes")).alias("x"), F.aggregate("sizes", F.lit(0), lambda a, b: a + b).alias("size"))
    sized = sized.select("page_id", "size", F.col("x.sentences").alias("sentence"), F.col("x.sizes").alias("n")).join(known, "sentence", "left_semi")
    made = sized.groupBy("page_id").agg((F.sum("n") * 2 >= F.min("size")).alias("made")).where("made")

    found = because(slot, "slot").union(because(template, "template")).union(because(made, "sentence"))
    found = found.union(because(keyed.where("syntax"), "syntax")).union(because(keyed.where("wording"), "wording"))
    names = F.array(*map(F.lit, REASONS))
    return found.groupBy("page_id").agg(F.get(names, F.min("reason")).alias("reason"))


def reasons(found: DataFrame) -> DataFrame:
    """The report: pages by what gave them away."""
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n_pages"))


def without_residue(pages: DataFrame) -> DataFrame:
    """The pages that are left."""
    return pages.join(residue_pages(pages).select("page_id"), "page_id", "left_anti")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return residue_pages(table(spark, sf_dir, "pages")).select("page_id")


def p3_kept(spark, sf_dir: str) -> DataFrame:
    """The pages without residue."""
    return without_residue(table(spark, sf_dir, "pages")).select("page_id", "url", "title")


def p3_reasons(spark, sf_dir: str) -> DataFrame:
    """Pages by reason."""
    return reasons(residue_pages(table(spark, sf_dir, "pages")))


QUERIES = {"p3_found": p3_found, "p3_kept": p3_kept, "p3_reasons": p3_reasons}
ORACLE: dict[str, str] = {}
