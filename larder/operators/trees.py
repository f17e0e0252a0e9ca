"""Element trees of single pages: nested microdata scopes, and sections under headings.

Small helpers that run inside tasks, page by page; none recurses, so depth has no limit.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of the first kind ends an open element of the second, up to an element of the third.
ENDS = {
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIMITS = frozenset("button table td th caption body html template object".split())


class Element:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def children(self) -> list[Element]:
        return [x for x in self.parts if not isinstance(x, str)]

    def text(self) -> str:
        """All text inside, trimmed."""
        out, open_ = [], [iter(self.parts)]
        while open_:
            part = next(open_[-1], None)
            if part is None:
                open_.pop()
            elif isinstance(part, str):
                out.append(part)
            else:
                open_.append(iter(part.parts))
        return "".join(out).strip()

    def within(self):
        """All elements inside, in page order."""
        open_ = [iter(self.children())]
        while open_:
            x = next(open_[-1], None)
            if x is None:
                open_.pop()
            else:
                yield x
                open_.append(iter(x.children()))

    def lines(self) -> list[str]:
        """The texts between line breaks, at any depth; empty ones go."""
        out, open_ = [[]], [iter(self.parts)]
        while open_:
            part = next(open_[-1], None)
            if part is None:
                open_.pop()
            elif isinstance(part, str):
                out[-1].append(part)
            elif part.tag == "br":
                out.append([])
            else:
                open_.append(iter(part.parts))
        return [x for x in ("".join(x).strip() for x in out) if x]


class Builder(HTMLParser):
    """A page's tree. End tags that fit nothing are left out; paragraphs, items and cells end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def close_to(self, tags, until) -> None:
        """Closes the outermost open element of tags that is reached before one of until."""
        x, found = self.at, None
        while x is not self.root and x.tag not in until:
            if x.tag in tags:
                found = x
            x = x.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        elif tag in BLOCKS:
            self.close_to(("p",), LIMITS)
        x = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.parts.append(x)
        if tag not in VOID:
            self.at = x

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root and x.tag != tag and not (tag in ("p", "li", "span", "b", "i", "a", "em", "strong") and x.tag in LIMITS):
            x = x.parent
        if x is not self.root and x.tag == tag:
            self.at = x.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Element:
    b = Builder()
    b.feed(html or "")
    b.close()
    return b.root


#: The type that marks a recipe, and properties that are lists even if they stand once.
RECIPE_TYPE = "schema.org/Recipe"
LISTS = ("recipeIngredient", "ingredients", "recipeInstructions", "step")
#: The attributes that hold a property's value, by tag; True: else the text.
VALUES = {"meta": (("content",), False), "img": (("src", "content"), False), "a": (("href",), False), "link": (("href",), False), "time": (("datetime",), True), "data": (("value",), True)}


def value(x: Element) -> str:
    names, or_text = VALUES.get(x.tag, ((), True))
    return next((x.attrs[n] for n in names if x.attrs.get(n)), x.text() if or_text else "")


def put(item: dict, name: str, told) -> None:
    if name in item:
        if not isinstance(item[name], list):
            item[name] = [item[name]]
        item[name].append(told)
    else:
        item[name] = [told] if name in LISTS else told


def scope(top: Element) -> dict:
    """The item of one scope; scopes inside that are named by a property become items of their own."""
    item: dict = {}
    open_ = [(item, iter(top.children()))]
    while open_:
        into, rest = open_[-1]
        x = next(rest, None)
        if x is None:
            open_.pop()
            continue
        names, is_scope = x.attrs.get("itemprop", ""), "itemscope" in x.attrs
        if not names:
            if not is_scope:
                open_.append((into, iter(x.children())))
            continue
        told: dict | str
        if is_scope:
            told = {}
            open_.append((told, iter(x.children())))
            kind = x.attrs.get("itemtype")
            if kind:
                # set before its properties, which may not be called @type
                told["@type"] = kind.split("/")[-1]
        else:
            told = value(x)
        for name in names.split():
            put(into, name, told)
    return item


def microdata(page: Element) -> list[dict]:
    """The items of all recipe scopes of a page, in page order; one inside another is its own as well."""
    return [scope(x) | {"@type": "Recipe"} for x in page.within() if RECIPE_TYPE in x.attrs.get("itemtype", "")]


#: How headings of the two sections begin, and headings below them that end a section.
INGREDIENTS = re.compile(r"(?:🛒\s*)?ingredients", re.I)
INSTRUCTIONS = re.compile(r"(?:👩‍🍳\s*)?(?:instructions|directions|steps|method|preparation|how\s+to\s+make)", re.I)
STOPS = ("note", "tip", "serving", "variation", "nutrition", "storage", "faq", "related", "you may", "final thoughts", "comment", "leave a", "rate this", "print", "similar", "more recipes", "post navigation", "latest posts")
STOP = re.compile(r"(?:🍽\s*)?(?:" + "|".join(s.replace(" ", r"\s+") for s in STOPS) + ")", re.I)
#: What betrays the text of a script.
SCRIPTS = re.compile("ezstandalone|ezoic|adsbygoogle|googletag|__cmp", re.I)
HEADINGS = ("h1", "h2", "h3", "h4")


def section(heading: Element) -> list[tuple[str, str]]:
    """(sub-heading, line) of the siblings after a heading: list items and lines of paragraphs.

    A heading of its rank or above ends the section, a lower one only if it begins like STOPS.
    A sub-heading stands before the first line that follows it; lines of script text are left out.
    """
    found, held = [], ""
    siblings = heading.parent.children()
    for x in siblings[next(i for i, s in enumerate(siblings) if s is heading) + 1 :]:
        if x.tag in HEADINGS:
            if x.tag <= heading.tag or STOP.match(x.text()):
                break
            if x.tag in ("h3", "h4"):
                held = re.sub(r"^\d+\.\s*", "", x.text())
            continue
        if x.tag == "p":
            lines = [] if SCRIPTS.search(x.text()) else [("p", s) for s in x.lines()]
        elif x.tag in ("ul", "ol"):
            lines = [("li", c.text()) for c in x.children() if c.tag == "li"]
        else:
            continue
        for kind, line in lines:
            if line and not SCRIPTS.search(line):
                found.append((kind, held, line))
                held = ""
    return found


def headings(page: Element) -> dict | None:
    """A recipe from the sections under an ingredients and an instructions heading; one of them is enough."""
    own: dict[str, Element] = {}
    first: dict[str, Element] = {}
    image = None
    for x in page.within():
        first.setdefault(x.tag, x)
        if x.tag == "meta" and image is None and x.attrs.get("property") == "og:image":
            image = x.attrs.get("content")
        if x.tag in HEADINGS and len(own) < 2:
            text = x.text()
            if "in" not in own and INGREDIENTS.match(text):
                own["in"] = x
            elif "steps" not in own and INSTRUCTIONS.match(text):
                own["steps"] = x
    items = [s for kind, _, s in section(own["in"]) if kind == "li"] if "in" in own else []
    steps = [f"{head}: {s}" if head else s for _, head, s in section(own["steps"])] if "steps" in own else []
    if not items and not steps:
        return None
    title = "Untitled Recipe"
    if "h1" in first:
        title = first["h1"].text()
    elif "title" in first:
        title = re.sub(r"\s*[|–—-]\s*.+", "", first["title"].text(), count=1)
    return {"@type": "Recipe", "name": title, "image": image, "recipeIngredient": items, "recipeInstructions": [{"@type": "HowToStep", "text": s} for s in steps]}
