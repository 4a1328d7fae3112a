"""Options of a conversion. Unknown names are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from quillspan.operators import tags as T

CLEAN = ("urls", "fragments", "empty_links", "empty_link_text", "empty_images", "redundant_links", "self_link_headings")


@dataclass(frozen=True)
class Override:
    """What a tag is written as: literals around its content, newlines around it, inline, without content; or as another tag."""

    enter: str | None = None
    exit: str | None = None
    spacing: tuple[int, int] | None = None
    inline: bool = False
    self_closing: bool = False
    alias: str = ""


@dataclass(frozen=True)
class Options:
    origin: str = ""
    clean: frozenset[str] = frozenset()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    process_children: bool = True
    isolate_main: bool = False
    frontmatter: bool = False
    meta_fields: tuple[str, ...] = ()
    tailwind: bool = False
    wrap_width: int = 0
    additional_fields: dict[str, str] = field(default_factory=dict)
    #: tag -> an Override, the name of a tag it is written like, or (before, after)
    overrides: dict[str, Override | str | tuple[str, str]] = field(default_factory=dict)
    max_text: int = 0

    def __post_init__(self) -> None:
        if bad := set(self.clean) - set(CLEAN):
            raise ValueError(f"unknown clean rules {sorted(bad)}; there are {', '.join(CLEAN)}")
        if self.wrap_width < 0 or self.max_text < 0:
            raise ValueError("widths can't be negative")
        for tag, x in self.overrides.items():
            if isinstance(x, str):
                self.overrides[tag] = Override(alias=x)
            elif isinstance(x, tuple):
                self.overrides[tag] = Override(*x)


def options(**given) -> Options:
    known = {f.name for f in fields(Options)}
    if bad := set(given) - known:
        raise ValueError(f"unknown options {sorted(bad)}; there are {', '.join(sorted(known))}")
    if given.get("clean") is True:
        given["clean"] = frozenset(CLEAN)
    return Options(**given)


def minimal(**given) -> Options:
    """Frontmatter, the main content, class marks, all clean rules and without page furniture."""
    own = Options(clean=frozenset(CLEAN), isolate_main=True, frontmatter=True, tailwind=True, exclude=tuple(sorted(T.MINIMAL_EXCLUDED)))
    more = options(**given)
    changed = {f.name: getattr(more, f.name) for f in fields(Options) if f.name in given}
    if "exclude" in changed:
        changed["exclude"] = own.exclude + changed["exclude"]
    return replace(own, **changed)
