"""Text, time and URL scalars as SQL text; each takes a dialect first."""

from __future__ import annotations

from .dialect import SPARK, Dialect
from .lines import SIZES, spellings

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Hosts that answer with pages no recipe can be read from.
BLOCKED = ("pinterest.com", "reddit.com", "example.org")
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "igshid", "igsh")
#: Addresses that must not be fetched.
UNSAFE_HOST = r"^(localhost|.*\.localhost|.*\.internal|.*\.local|127\..*|10\..*|0\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[.*)$"
#: Strings that mark a page of a bot protection.
BLOCK_WORDS = (
    "Access to this page has been denied",
    "Please verify you are a human",
    "Enable JavaScript and cookies to continue",
    "Checking if the site connection is secure",
    "Attention Required! | Cloudflare",
    "Just a moment...",
    "cf-browser-verification",
    "_cf_chl_opt",
)
#: Preset tags and the words that bring them.
TAGS = {
    "breakfast": ("breakfast", "brunch", "morning"),
    "lunch/dinner": ("dinner", "lunch", "main course", "main dish", "entree", "entrée", "supper", "main"),
    "dessert": ("dessert", "desserts", "baking", "cake", "cookies", "pastry", "sweet"),
    "snacks": ("snack", "snacks", "appetizer", "appetizers", "starter", "starters", "side dish", "side"),
    "crockpot": ("slow cooker", "crock pot", "crockpot", "crock-pot"),
    "soups": ("soup", "soups", "stew", "stews", "chili", "bisque", "chowder"),
    "kid-friendly": ("kid-friendly", "kid friendly", "kids", "family", "family-friendly", "family friendly", "child-friendly"),
}
#: Whole words, and beginnings of words, with which no instruction starts.
NO_STEP_WORDS = ("i", "just", "this", "the", "my", "we", "you", "it", "these", "those", "here", "there", "please", "also", "btw", "fyi", "serve", "serves")
NO_STEP_STARTS = ("note:", "disclaimer", "adapted", "originally", "inspired", "source", "credit", "photo", "image", "video", "recipe by", "recipe from")
#: What tells an ingredient without a number.
QUALIFIERS = ("to taste", "to garnish", "to garnishing", "for garnish", "for garnishing", "as needed")
#: An amount's digits and what may follow in it.
AMOUNT = "[0-9½¼¾⅓⅔][0-9/.½¼¾⅓⅔-]*"
#: What stands beside a word; engines differ in what their own word boundary knows of letters.
NO_WORD = r"[^\p{L}0-9_]"
#: Verbs that tell a cooking step.
VERBS = (
    "cook", "bake", "roast", "grill", "saute", "sauté", "fry", "simmer", "boil", "steam", "broil", "braise", "brown", "stir", "mix", "combine", "whisk", "fold", "blend", "chop", "dice", "slice",
    "mince", "peel", "drain", "heat", "preheat", "melt", "pour", "add", "toss", "season", "marinate", "spread", "serve", "refrigerat", "chill", "freeze", "let sit", "set aside", "bring to", "stir in",
    "fold in", "top with", "remove from", "place in", "transfer", "arrange",
)
#: A step is longer than this.
STEP_LONGER = 20


def host(d: Dialect, u: str) -> str:
    return f"lower({d.extract(u, HOST)})"


def source_domain(d: Dialect, u: str) -> str:
    """Host without www., '' where there is none."""
    return f"coalesce({d.replace(host(d, u), '^www[.]')}, '')"


def route(d: Dialect, u: str) -> str:
    """What kind of extraction an address asks for."""
    rules = [("image", r"[.](jpe?g|png|webp|gif)([?#].*)?$"), ("tiktok", r"tiktok[.]com"), ("youtube", r"(youtube[.]com|youtu[.]be)"), ("facebook", r"(facebook[.]com|fb[.]watch)"), ("instagram", r"instagram[.]com")]
    return "case " + " ".join(f"when {d.like(f'lower({u})', p)} then '{k}'" for k, p in rules) + " else 'web' end"


def canonical_url(d: Dialect, u: str) -> str:
    """Without tracking parameters and fragment, host in lower case; other text unchanged."""
    bare = d.replace(u, "#.*$")
    query = d.extract(bare, r"\?(.*)$")
    kept = d.join(d.filter(d.split(query, "&"), "q", f"q <> '' and {d.extract('q', '^([^=]*)')} not in ({', '.join(repr(t) for t in TRACKING)})"), "&")
    start = d.extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://)")
    rest = d.extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)")
    return f"case when {host(d, u)} = '' then {u} else concat({start}, {host(d, u)}, case when {rest} = '' then '/' else {rest} end, case when {kept} <> '' then concat('?', {kept}) else '' end) end"


def is_unsafe(d: Dialect, u: str) -> str:
    """Not http(s), a private or local host, or no host at all."""
    return f"(not {d.like(f'lower({u})', '^https?://')} or {host(d, u)} = '' or {d.like(host(d, u), UNSAFE_HOST)})"


def http_only(d: Dialect, u: str) -> str:
    return f"case when {d.like(u, '^https?:')} then {u} end"


def is_blocked(d: Dialect, u: str) -> str:
    """P2 as a predicate: the host is a listed one or below it."""
    h = host(d, u)
    return "(" + " or ".join(f"{h} = '{b}' or {h} like '%.{b}'" for b in BLOCKED) + ")"


def is_block_page(d: Dialect, html: str) -> str:
    """A protection page, or too short to be any."""
    return f"(length({html}) < 1500 or " + " or ".join(f"contains({html}, '{w}')" for w in BLOCK_WORDS) + ")"


def page_has_recipe(d: Dialect, html: str) -> str:
    """P5: marked as a recipe, or with both headings."""
    heading = lambda w: d.like(html, rf"(?i)<h[1-4][^>]*>[^<]*{w}")
    marked = d.like(html, r'(?i)"@type"\s*:\s*\[?\s*"[^"]*recipe"') + " or " + d.like(html, r"(?i)itemtype=\S*schema[.]org/recipe")
    return f"({marked} or ({heading('ingredients')} and {heading('(instructions|directions|method|on)')}))"


def first_url(d: Dialect, t: str) -> str:
    """The first web address in a text."""
    return f"nullif({d.extract(t, '(https?://[^ <>]+)')}, '')"


def video_id(d: Dialect, u: str) -> str:
    return f"nullif({d.extract(u, r'(?:v=|youtu[.]be/|shorts/|embed/)([A-Za-z0-9_-]{11})')}, '')"


def shortcode(d: Dialect, u: str) -> str:
    return f"nullif({d.extract(u, r'instagram[.]com/(?:[^/]+/)?(?:p|reel|tv)/([A-Za-z0-9_-]+)')}, '')"


def embed_url(d: Dialect, u: str) -> str:
    return f"case when {shortcode(d, u)} is not null then concat('https://www.instagram.com/p/', {shortcode(d, u)}, '/embed/captioned/') end"


def affiliate(d: Dialect, u: str) -> str:
    """With the campaign's parameters."""
    return f"case when contains({u}, '?') then concat({u}, '&utm_campaign=larder') else concat({u}, '?utm_campaign=larder') end"


def iso_minutes(d: Dialect, s: str) -> str:
    """Minutes of an ISO-8601 duration, null for none."""
    part = lambda p: f"coalesce({d.whole(d.extract(s, p))}, 0)"
    total = f"({part('P([0-9]+)D')} * 1440 + {part('P(?:[0-9]+D)?T?([0-9]+)H')} * 60 + {part('P(?:[0-9]+D)?T?(?:[0-9]+H)?([0-9]+)M')} + cast(floor({part('P(?:[0-9]+D)?T?(?:[0-9]+H)?(?:[0-9]+M)?([0-9]+)S')} / 60.0 + 0.5) as bigint))"
    return f"nullif({total}, 0)"


def informal_minutes(d: Dialect, s: str) -> str:
    """1.5 hr 30 min, 45, 2 hours; null for none."""
    t = f"lower(trim({s}))"
    h = d.number(d.extract(t, r"([0-9]+(?:[.][0-9]+)?)\s*(?:hours?|hrs?|h)\b"))
    m = d.number(d.extract(t, r"([0-9]+(?:[.][0-9]+)?)\s*(?:minutes?|mins?|m)\b"))
    bare = d.number(d.extract(t, r"^([0-9]+)$"))
    return f"nullif(cast(floor(coalesce({h} * 60 + coalesce({m}, 0), {m}, {bare}, 0) + 0.5) as bigint), 0)"


def strip_cost(d: Dialect, t: str) -> str:
    """Without price notes."""
    return f"trim({d.replace(t, r'\s*\(\$[0-9]+(?:[.][0-9]+)?\)')})"


def clean_food_name(d: Dialect, n: str) -> str:
    """Lower case, without brackets, what follows a comma, and alternatives after a slash."""
    bare = d.replace(f"lower(trim({n}))", r"\s*\([^)]*\)\s*", " ")
    return f"trim({d.replace(d.replace(bare, ',.*$'), r'\s*/\s*.+$')})"


def client_ip(d: Dialect, header: str, peer: str) -> str:
    """The left-most forwarded address, else the peer's."""
    return f"coalesce(nullif(trim({d.at(d.split(header, ','), 1)}), ''), nullif({peer}, ''), 'unknown')"


def slug(d: Dialect, t: str) -> str:
    return f"substring({d.replace(f'lower({t})', '[^a-z0-9]+', '-')}, 1, 40)"


def leading_number(d: Dialect, s: str) -> str:
    """X11: the number that a text starts with."""
    return d.number(d.extract(s, r"^\s*([-+]?[0-9]*[.]?[0-9]+)"))


def servings(d: Dialect, s: str) -> str:
    return d.whole(d.extract(s, "([0-9]+)"))


def string_list(d: Dialect, s: str) -> str:
    """Parts of a comma list, trimmed, without empty ones."""
    return d.filter(d.map(d.split(s, ","), "p", "trim(p)"), "p", "p <> ''")


def auto_tags(d: Dialect, *terms: str) -> str:
    """Tags any of whose words occurs in a term, in the rules' order, joined."""
    text = "lower(concat_ws('|', " + ", ".join(terms) + "))"
    return "concat_ws(',', " + ", ".join(f"case when {' or '.join(f'contains({text}, {w!r})' for w in ws)} then '{t}' end" for t, ws in TAGS.items()) + ")"


def is_instruction(d: Dialect, t: str) -> str:
    """P10: long enough, and no commentary by its first word; "serve" only stands before "immediately"."""
    low = f"lower(trim({t}))"
    starts = "|".join([f"(?:{'|'.join(NO_STEP_WORDS)})(?:$|{NO_WORD})", *(s.replace(" ", " +") for s in NO_STEP_STARTS)])
    return f"(length(trim({t})) >= 5 and not ({d.like(low, f'^(?:{starts})')} and not {d.like(low, '^serves? +immediately')}))"


def any_of(words, space: str = " +") -> str:
    return "|".join(w.replace(" ", space) for w in words)


def units_after_number(sizes: bool = False) -> list[str]:
    """Spellings of units that may follow a number, longest first; of single letters g only."""
    return [s for s in spellings() if (len(s) > 1 or s == "g") and (sizes or s not in SIZES)]


def likely_ingredient(d: Dialect, t: str) -> str:
    """A number with a unit, a short line from a fraction or number to a word without a cooking verb, or a qualifier."""
    low = f"lower({t})"
    measured = d.like(low, rf"^{AMOUNT} *(?:{any_of(units_after_number(True))})(?:$|{NO_WORD})")
    counted = f"({d.like(low, rf'^(?:{AMOUNT[:-1]}+|[0-9]+) +[a-z]')} and not {has_verb(d, t)} and length({t}) < 60)"
    words, short = d.like(low, rf"(?:^|{NO_WORD})(?:{any_of(QUALIFIERS)})(?:$|{NO_WORD})"), f"length({t}) < 80"
    qualified = f"({short} and {words})" if d is SPARK else f"({words} and {short})"  # Spark tests in this order, and no long text for its words
    return f"({measured} or {counted} or {qualified})"


#: A cooking verb as a word, in lower case.
VERB_WORD = rf"(?:^|{NO_WORD})(?:{any_of(VERBS)})(?:$|{NO_WORD})"


def has_verb(d: Dialect, t: str) -> str:
    """T4: a cooking verb as a word."""
    return d.like(f"lower({t})", VERB_WORD)


def reads_like_step(d: Dialect, t: str) -> str:
    """T4: long enough, with a cooking verb."""
    return f"(length({t}) > {STEP_LONGER} and {has_verb(d, t)})"


def is_ad(d: Dialect, t: str) -> str:
    return d.like(t, r"(?i)(adsbygoogle|googletag|ad-slot|sponsored)")


def strip_number(d: Dialect, t: str) -> str:
    return f"trim({d.replace(t, r'^\s*(?:Step\s+)?[0-9]+[.):]\s*')})"


def sentences(d: Dialect, t: str) -> str:
    """Sentences, cut after .!? and white space; lines where there are several."""
    marked = d.replace(t, r"([.!?])\s+([A-Z])", "$1\x01$2")
    parts = f"case when contains({t}, chr(10)) then {d.split(t, chr(92) + 'n+')} else {d.split(marked, chr(1))} end"
    return d.filter(d.map(parts, "p", strip_number(d, "p")), "p", "p <> ''")


#: Code points of decorated letters, of pictures, and of characters that rule a line off.
DECORATED, PICTURES, RULES = "\U0001d400-\U0001d7ff", "\U0001f300-\U0001faff\u2600-\u27bf\ufe00-\ufeff", "•\\-=─━·"


def clean_caption(d: Dialect, t: str) -> str:
    """Without hashtags, calls to comment or follow, decorated letters, lines of pictures and ruled-off lines; blank lines folded."""
    lines = "(?dm)" if d.name == "spark" else "(?m)"
    out = d.replace(t, "#[A-Za-z0-9_]+")
    for call in (r"\bcomment\s+[A-Za-z0-9_]+\s+and\s+I['’]ll\b.*$", r"\bcomment\s+[A-Za-z0-9_]+\b.*send\b.*$", r"^follow\s+(?:for|me|us)\b.*$"):
        out = d.replace(out, f"{lines[:-1]}i){call}")
    for gone in (f"[{DECORATED}]+", rf"{lines}^[\s{PICTURES}]+$", rf"{lines}^[{RULES}\s]{{5,}}$"):
        out = d.replace(out, gone)
    return d.replace(d.replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$")


def primary_timer(d: Dialect, t: str) -> str:
    """Q8: the longest time in a text, in seconds; of a range the upper end; 2 hours and 30 ... are added first."""
    unit = "(hours?|hrs?|minutes?|mins?|seconds?|secs?)"
    compound = r"([0-9]+)\s+hours?\s+(?:and\s+)?([0-9]+)\s+(?:hours?|hrs?|minutes?|mins?|seconds?|secs?)"
    c = d.map(d.all(f"lower({t})", compound, 0), "x", f"coalesce({d.whole(d.extract('x', '^([0-9]+)'))}, 0) * 3600 + coalesce({d.whole(d.extract('x', r'\s([0-9]+)\s'))}, 0) * 60")
    rest = d.replace(f"lower({t})", compound, " ")
    seconds = f"coalesce({d.whole(d.extract('x', r'([0-9]+)\s+[a-z]+$'))}, 0) * (case substring({d.extract('x', r'([a-z]+)$')}, 1, 1) when 'h' then 3600 when 'm' then 60 else 1 end)"
    s = d.map(d.all(rest, rf"(?:[0-9]+\s*(?:to|-)\s*)?[0-9]+\s+{unit}", 0), "x", seconds)
    top = (lambda a: f"array_max({a})") if d.name == "spark" else (lambda a: f"list_max({a})")
    return f"nullif(greatest(coalesce({top(c)}, 0), coalesce({top(s)}, 0)), 0)"
