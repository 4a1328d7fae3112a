"""Lines that belong to the page around an article, told by their wording, in six languages.

The patterns describe what such lines say (who wrote it and when, how long it takes to read,
which version it describes, promotions, sharing, rating, newsletters, related pages, tags,
comments, rights, consent, accounts and search), each as it begins or as a whole. They are
matched from the beginning of lines without heading, list or table marks, so that sentences
inside paragraphs are never concerned; a line of any length can be furniture.
"""

from __future__ import annotations

import re
from functools import lru_cache

from quillspan.llm.folding import match_folded, match_form, pattern_form

#: kind -> patterns, matched from the start of a line in lower case with single spaces.
PATTERNS: dict[str, tuple[str, ...]] = {
    "byline": (
        r"(?:published|written|reviewed|maintained|edited|posted|translated|authored) by\b.{1,120}$",
        r"by .{1,60} · \d",
        r"(?:verfasst|geschrieben|geprüft|veröffentlicht|gepflegt) von\b.{1,120}$",
        r"von der redaktion\b",
        r"(?:rédigé|écrit|publié|relu) par\b.{1,120}$",
        r"(?:escrito|publicado|revisado|redactado) por\b.{1,120}$",
        r"(?:автор|авторы|написано|подготовлено|опубликовано|проверено|материал подготов).{1,120}$",
    ),
    "reading": (
        r"(?:about |approx\. )?\d+[- ]?min(?:ute)?s? read\b",
        r"reading time\b",
        r"a text of about \d+ minutes?",
        r"estimated reading\b",
        r"lesezeit\b",
        r"temps de lecture\b",
        r"tiempo de lectura\b",
        r"время чтения\b",
        r"読み終わるまで",
        r"読了",
    ),
    "version": (
        r"applies to .{1,60}\d+(?:\.\d+)* and (?:later|newer|above)",
        r"this page describes (?:version|release)\b",
        r"you are reading the (?:notes|docs|documentation|page|text) for\b",
        r"diese seite beschreibt (?:ausgabe|version)\b",
        r"(?:gilt|gültig) (?:für|ab) .{1,60}\d+",
        r"cette page décrit la version\b",
        r"s’applique à .{1,60}\d+",
        r"esta página describe la versión\b",
        r"se aplica a .{1,60}\d+",
        r"эта страница описывает (?:выпуск|версию)\b",
        r"(?:этот текст|страница) относится к (?:выпуску|версии)\b",
        r"(?:この|本)ページ(?:は|では).{1,60}版.{0,20}(?:説明|対象|もの|ついて)",
    ),
    # on the page as a whole, unlike the remarks that belong to a section
    "translation": (
        r"(?:note\s?: ?)?translations? of this (?:text|page|article) (?:is|are|was|were) (?:made|provided|maintained|done) by\b",
        r"(?:hinweis\s?: ?)?übersetzungen dieser seite\b",
        r"(?:remarque\s?: ?)?les traductions de cette page\b",
        r"(?:nota\s?: ?)?las traducciones de esta página\b",
        r"(?:примечание\s?: ?)?переводы этой страницы\b",
        r"(?:注\s?[:：] ?)?このページの翻訳は",
    ),
    "promotion": (
        r"(?:partner offer|advertisement|promotion|sponsored|sponsor|our partner|from the market|special offer|ad|offer)\s?:",
        r"(?:anzeige|werbung|angebot)\s?:",
        r"(?:publicité|annonce|offre partenaire)\s?:",
        r"(?:publicidad|anuncio|oferta)\s?:",
        r"(?:реклама|объявление|предложение партнёра)\s?:",
        r"(?:広告|ＰＲ|pr)\s?[:：]",
        r"\d+ people are reading this right now",
    ),
    "related": (
        r"#* ?(?:more|other) (?:articles|posts|texts|pages) (?:from|on|by|about)\b",
        r"#* ?(?:weitere|andere) (?:beiträge|artikel|seiten)\b",
        r"#* ?autres articles\b",
        r"#* ?otros artículos\b",
        r"#* ?другие статьи\b",
        r"#* ?.{1,60}のほかの記事",
        r"(?:next|previous|earlier|later|up next|back to|continue with|read next|read also|see also|related)\s?:",
        r"(?:zurück|weiter|vorheriger beitrag|nächster beitrag|lesen sie auch)\s?:",
        r"(?:précédent|suivant|à lire aussi|lire aussi)\s?:",
        r"(?:anterior|siguiente|lea también)\s?:",
        r"(?:назад|далее|предыдущая статья|следующая статья|читайте также|предыдущая|следующая|раньше|ранее)\s?:",
        r"(?:前の記事|次の記事|あわせて読みたい|関連記事)\s?[:：]",
        r"you (?:might|may) also like\b",
        r"readers of this (?:text|article|page)\b",
        r"popular this (?:week|month)\b",
    ),
    "sharing": (
        r"share this\b",
        r"tell a friend about\b",
        r"like this\? pass it on",
        r"print this page\b",
        r"download this (?:article|page|text)\b",
        r"listen to .{1,80} as audio",
        r"translate .{1,60}$",
        r"(?:diesen |den )?(?:beitrag|artikel) (?:teilen|weiterempfehlen|drucken)\b",
        r"(?:partager|envoyer|imprimer) cet(?:te)? (?:page|article)\b",
        r"(?:compartir|enviar|imprimir) est[ae] (?:página|artículo)\b",
        r"поделиться (?:этой|страницей|статьёй)\b",
        r"このページを.{0,20}(?:共有|印刷)",
    ),
    "rating": (
        r"(?:was|did) this (?:article|page|text)\b",
        r"rate this (?:text|page|article)\b",
        r"report a mistake in\b",
        r"war diese seite\b",
        r"cette page vous a-t-elle\b",
        r"¿le ha (?:sido|resultado) útil\b",
        r"была ли эта страница\b",
        r"このページは役に立ちましたか",
    ),
    "newsletter": (
        r"subscribe\b",
        r"join \d+ readers\b",
        r"get .{1,60} news\b",
        r"follow .{1,60} for\b",
        r"(?:rundbrief|newsletter)\b",
        r"neue ausgaben von\b",
        r"recevoir la lettre\b",
        r"suscríbase\b",
        r"подписаться\b",
    ),
    "tags": (
        r"(?:tags|keywords|filed under|topics|schlagwörter|mots-clés|etiquetas|метки|タグ)\s?[:：]",
    ),
    "comments": (
        r"log in to comment\b",
        r"latest comment (?:on|by)\b",
        r"(?:\d+ comments|leave a comment|comment on)\b",
        r"kommentar zu\b",
        r"commenter \S+$",
        r"comentar \S+$",
        r"оставить комментарий\b",
    ),
    "rights": (
        r"©",
        r"copyright\b",
        r"all product names are property\b",
        r"registered office\b",
        r"built from revision\b",
        r"(?:the|all) information on this (?:site|page|website)\b.{0,80}(?:warranty|guarantee)",
        r"no guarantee is given\b",
        r"nothing here is advice\b",
        r"terms(?: of use)? · ",
        r"impressum · ",
        r"mentions légales · ",
        r"aviso legal · ",
        r"условия использования · ",
        r"利用規約・",
        r"alle angaben ohne gewähr",
        r"für die richtigkeit wird nicht gehaftet",
        r"informations fournies sans aucune garantie",
        r"la información se ofrece sin garantía",
        r"сведения приводятся без\b",
        r"掲載内容について.{0,20}保証",
    ),
    "consent": (
        r"(?:we|this (?:site|website|service|portal)) (?:use|uses|stores?) (?:cookies|small files|data)\b",
        r"by (?:using|browsing|staying on) .{1,60} you (?:agree|accept)\b",
        r"(?:wir verwenden|diese seite (?:nutzt|verwendet)) cookies\b",
        r"mit der weiteren nutzung\b",
        r"nous utilisons des (?:témoins|cookies)\b",
        r"en poursuivant votre visite\b",
        r"usamos cookies\b",
        r"si continúa en\b",
        r"мы используем файлы cookie\b",
        r"оставаясь на\b.{1,60}вы соглашаетесь",
    ),
    "menu": (
        r"(?:log in|sign in|register)(?: · | to your )",
        r"(?:getting started with|quick start for|install) \S+$",
        r"(?:erste schritte mit|primeros pasos con|premiers pas avec|начало работы с) \S+$",
        r"skip to the (?:main )?content\b",
        r"search (?:all of \S+|\S+ documentation)$",
        r"type to search\b",
        r"my .{1,60} account and orders",
        r"zum inhalt von\b",
        r"aller au contenu\b",
        r"saltar al contenido\b",
        r"перейти к (?:основному )?содержанию\b",
        r"(?:home|start|accueil|inicio|главная|ホーム) › ",
    ),
}

#: (kind, a text that the line holds, the pattern of the whole line).
ANYWHERE: tuple[tuple[str, str, str], ...] = (
    ("byline", "更新日", r".{0,60}更新日\s*\d"),
    ("byline", "編集部", r".{1,60}編集部.{0,12}(?:執筆|作成|公開|更新)"),
    ("promotion", "looking for a writer", r".{1,60} is looking for a writer in your area"),
    ("related", "ほかの記事", r"#* ?.{1,60}のほかの記事"),
    ("newsletter", "最新情報", r".{1,60}最新情報をメールで"),
    ("comments", "no answers yet", r".{1,60}: no answers yet\b"),
    ("comments", "コメントする", r".{1,60}にコメントする"),
    ("rights", "reuse only with", r".{1,60}\d{4} – reuse only with permission"),
    ("consent", "and its partners", r".{1,60} and its partners (?:use|store)\b"),
    ("consent", "クッキー", r".{1,60}クッキーを使用"),
    ("consent", "同意", r".{0,60}(?:ご利用|利用).{0,30}同意"),
    ("menu", "本文へ移動", r".{1,60}の本文へ移動"),
    ("menu", "初めて使う", r".{1,60}を初めて使う方へ"),
)

_COMPILED = {kind: re.compile(pattern_form("|".join(p))) for kind, p in PATTERNS.items()}


def _options(pattern: str) -> list[str]:
    """The alternatives of a pattern."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(c)
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _first(pattern: str) -> set[str]:
    """The characters that a match of a pattern can begin with, "" for any; its classes of characters hold no brackets or bars."""
    if len(options := _options(pattern)) > 1:
        return set().union(*map(_first, options))
    if pattern.startswith("(?:"):
        depth = at = 0
        while True:
            depth += (pattern[at] == "(") - (pattern[at] == ")")
            at += 2 if pattern[at] == "\\" else 1
            if not depth:
                break
        return {""} if pattern[at : at + 1] in ("", *"?*{") else _first(pattern[3 : at - 1])
    return {""} if pattern[:1] in ("", *".\\[(^$") or pattern[1:2] in ("?", "*", "{") else {pattern[0]}


def _by_first(patterns: list[str]) -> dict[str, re.Pattern]:
    """Of each character, the patterns that can match a line which begins with it; at "" those for all others."""
    firsts = [_first(p) for p in patterns]
    return {c: re.compile("|".join(f"(?:{p})" for p, f in zip(patterns, firsts, strict=True) if "" in f or c in f)) for c in {""}.union(*firsts)}


_ANY = _by_first([o for p in PATTERNS.values() for x in p for o in _options(pattern_form(x))])
_HELD = tuple((kind, text, re.compile(p)) for kind, text, p in ANYWHERE)
_TARGET = re.compile(r"\]\([^()\s]*\)")
#: Remarks that belong to a section of the article.
REMARK = re.compile(
    pattern_form(r"(?:note|hinweis|remarque|nota|примечание|注意|注)\s?[:：]|the examples (?:in|of) this section\b|die beispiele in diesem abschnitt\b|les exemples de cette section\b|los ejemplos de esta sección\b|примеры (?:в|из) это(?:м|го) раздел|この節の例")
)


@lru_cache(1 << 12)
def normal(line: str) -> str:
    s = " ".join(line.split())
    if "](" in s:
        s = _TARGET.sub("", s).replace("[", "")
    return match_form(s).replace("'", "’")


def normals(lines: list[str], folded: str) -> list[str]:
    """:func:`normal` of lines with single spaces, in one pass over all; ``folded`` is their text, a line each, folded."""
    if not lines:
        return []
    if any("](" in s for s in lines):
        return match_form("\n".join(_TARGET.sub("", s).replace("[", "") if "](" in s else s for s in lines)).replace("'", "’").split("\n")
    return match_folded(folded).replace("'", "’").split("\n")


def _any(s: str) -> bool:
    return (_ANY.get(s[:1]) or _ANY[""]).match(s) is not None


@lru_cache(1 << 14)
def _begins(s: str) -> bool:
    return _any(s) and (not REMARK.match(s) or _COMPILED["translation"].match(s) is not None)


def _holds(s: str) -> bool:
    return not _any(s) and any(text in s and p.match(s) is not None for _, text, p in _HELD)


def worded(forms: list[str | None]) -> list[bool]:
    """:func:`is_furniture` of lines in their form for matching; None is no furniture."""
    found = [s is not None and _begins(s) for s in forms]
    whole = "\n".join(filter(None, forms))
    if any(text in whole for _, text, _ in _HELD):
        found = [x or (s is not None and _holds(s)) for x, s in zip(found, forms, strict=True)]
    return found


@lru_cache(1 << 14)
def is_furniture(line: str) -> bool:
    """By its wording; the lines of menus and footers come again on every page of a site."""
    return worded([normal(line)])[0]


def kind_of(line: str) -> str | None:
    if not is_furniture(line):
        return None
    s = normal(line)
    return next((k for k, p in _COMPILED.items() if p.match(s)), None) or next(
        k for k, text, p in _HELD if text in s and p.match(s)
    )
