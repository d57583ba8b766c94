"""Text functions as Spark column expressions.

Nulls give null (or an empty array where an array is returned) unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of indicators in report text.
HASHES = {"MD5": r"\b[a-fA-F0-9]{32}\b", "SHA1": r"\b[a-fA-F0-9]{40}\b", "SHA256": r"\b[a-fA-F0-9]{64}\b", "SHA512": r"\b[a-fA-F0-9]{128}\b"}
CIDR = r"\b((?:\d{1,3}\.){3}\d{1,3}/\d{1,2})\b"
IPV4 = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
REGISTRY_KEY = r"(?i)\b(HK(?:LM|CU|CR|U|CC)|HKEY_(?:LOCAL_MACHINE|CURRENT_USER|CLASSES_ROOT|USERS|CURRENT_CONFIG))\\[\\\w]+"
REGISTRY_VALUE = r"\b(WDigest|MaxMpxCt|UseLogonCredential|Real-time protection)\b"
PATHS = (r"(?i)%[A-Za-z]+%\\[\w.\\$-]+", r"(?i)[A-Z]:\\[\w\\$. -]+", r"(?<![\w/])(/(?:srv|tmp|var|etc|usr|opt|home|root)/[\w/.\-]+)")
TECHNIQUE_ID = r"\bT\d{4}(?:\.\d{3})?\b"
CVE = r"(?i)CVE-\d{4}-\d{4,7}"
FILENAME = r"(?i)\b([A-Za-z][\w.-]{2,30})\.(ps1|exe|bat|sh|py|dll|jar)\b"
# words are letters and digits of any script here; \b and \w know them in some Java versions only
NAME_VERSION = r"(?<![\p{L}\p{N}_])([A-Za-z][\p{L}\p{N}_-]{2,30})[\t-\r\x1c-\x20\x85\xa0\p{Z}]+v?([0-9]+\.[0-9]+(?:\.[0-9]+(?:\.[0-9]+)?)?)(?![\p{L}\p{N}_])"
TOOL_TRIGGER = r"(?i)(?:download|execute|use|run|invoke|leverage|deploy|via)\s+(?:[a-z]+\s+){0,3}`?\*?\*?([A-Z][\w-]{2,30}(?:\.[a-z]{2,4})?)"
HOST_IP = r"(?i)`?([a-z][a-z0-9-]{1,30})`?\s*\(\s*((?:\d{1,3}\.){3}\d{1,3})\s*\)"
DOMAIN_USER = r"\b([A-Z][A-Z0-9_-]{1,30})\\([A-Za-z][A-Za-z0-9._-]+)\b"
ACCOUNT = r"(?i)(?:account|admin|user|credentials? for(?: the)?)\s+(?:[a-z]+\s+){0,3}`([A-Za-z][\w._-]+)`"
EXTENSION = r"(?i)(?:append(?:ed)?\s+with|renamed?\s+to|suffix(?:ed)?\s+with|extension\s*[:=]?)[^.\n]{0,40}`?\.([A-Za-z][A-Za-z0-9]{2,10})`?"
SECRET = r"\bsk-[A-Za-z0-9_-]{8,}\b"
OUTPUT_MARKER = r"\[\[\s*##\s*\w+\s*(?:##\s*)?\]\]"
SECRET_KEY = r"(?i)(api[-_]?key|authorization|bearer|(?<!max_)token|secret|password|passwd|credential)"
# Host names in lists, what is no host, no account and no tool.
LISTED_HOST = r"(?m)(?:^\s*[\*\-]\s+|\"|\`)([a-zA-Z][a-zA-Z0-9-]{2,30})(?:\"|\`)?\s*$"
HOST_WORD = r"(?i)\b(host|hostname|computer|machine|target)s?\b"
HOST_ENDINGS = ("mon", "srv", "server", "dc", "host", "box")
NO_HOSTS = ("http", "https", "tcp", "udp")
NO_LISTED_HOSTS = ("the", "next", "also", "step", "phase", "all")
NO_ACCOUNTS = ("username", "user", "password", "credential")
NO_PROSE_ACCOUNTS = (
    "rdp", "ssh", "smb", "kerberos", "ldap", "bitsadmin", "powershell", "exmatter", "infostealer", "blackcat", "windows", "linux", "the", "and",
)
NO_TOOLS = (
    "powershell", "command", "credentials", "domain", "registry", "task", "windows", "linux", "remote", "downloads", "office", "edge", "firefox", "chrome", "files", "extension",
)
#: Fixed list: verbs of a report's author, not of an actor.
REPORTER_VERBS = ("report", "describe", "note", "observe", "identify", "analyze", "assess", "document", "publish", "state")
#: Fixed list: words that say nothing about a technique.
REPORT_WORDS = ("analyze", "observe", "identify", "report", "highlight", "find")
#: Fixed list: extensions that are no markers.
EXTENSION_STOPLIST = (
    "com", "net", "org", "gov", "edu", "io", "html", "htm", "php", "asp", "aspx", "jsp", "json", "xml", "txt", "log", "md", "pdf", "png", "jpg",
    "jpeg", "gif", "svg", "yml", "yaml", "csv", "exe", "dll", "ps1", "py", "sh", "bat", "cmd", "ini", "conf", "cfg", "iso", "zip", "tar", "gz", "bz2",
    "xz", "rar", "msi", "lnk", "dat", "rs", "go", "js", "ts", "java", "cs", "cpp", "c", "h", "hpp", "rb", "pl", "swift", "kt", "manifest", "doc",
    "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "tex", "name", "type", "url", "ref", "key", "val", "id", "tag",
)
#: Fixed pairs: a phrase and what stands for any text that contains it.
CANONICAL_PHRASES = (
    ("tampering with group policy objects", "modify domain policy configuration"),
    ("tamper with group policy objects", "modify domain policy configuration"),
    ("weaken organizational security posture", "degrade security controls"),
)
#: Fixed list: words that mark an actor name wherever they stand in it.
ACTOR_CUES = ("group", "apt", "team", "gang", "operator", "raas")


def strip(x: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def slug(x: Column) -> Column:
    """Lower case, runs of other characters as one dash, no dash at the ends; null gives an empty string."""
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def spaced(x: Column) -> Column:
    """Lower-case alphanumeric runs with one blank between."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def sorted_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def matches(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def clean_stem(name: Column) -> Column:
    """``report.md`` gives ``report_md``; a name without extension stays."""
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when((ext != "") & (stem != ""), F.concat_ws("_", stem, F.lower(ext))).otherwise(name)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def normal_actor(x: Column) -> Column:
    """Without possessive endings and the literals ``operator`` and ``team`` (as written)."""
    return strip(F.replace(F.replace(F.regexp_replace(x, "’s|'s$", ""), F.lit("operator"), F.lit("")), F.lit("team"), F.lit("")))


def valid_actor(x: Column) -> Column:
    """At most five words and either a cue inside the name or a short alphanumeric name with a letter."""
    few = F.size(F.split(strip(x), r"\s+")) <= 5
    cue = F.lower(x).rlike("|".join(ACTOR_CUES))
    plain = (F.length(x) <= 25) & x.rlike(r"^[\p{L}\p{N}\s-]+$") & x.rlike(r"\p{L}")
    return F.coalesce(few & (cue | plain), F.lit(False))


def split_clauses(x: Column) -> Column:
    """Clauses between and, then, but, before, after and commas, of more than three characters."""
    parts = F.transform(F.split(x, r"(?i)\b(?:and|then|but|before|after|,)\b"), lambda p: strip(p))
    return F.filter(parts, lambda p: F.length(p) > 3)


def canonical_phrase(x: Column) -> Column:
    out = F.lower(strip(x))
    chain = None
    for phrase, to in CANONICAL_PHRASES:
        chain = F.when(F.contains(out, F.lit(phrase)), to) if chain is None else chain.when(F.contains(out, F.lit(phrase)), to)
    return chain.otherwise(out)


def evidence_window(x: Column, start: Column, length: Column, span: int = 100) -> Column:
    """``span`` characters on both sides of a match that starts at ``start`` (from 1), newlines as blanks."""
    begin = F.greatest(F.lit(1), start - span)
    return strip(F.replace(F.substring(x, begin, start + length + span - begin), F.lit("\n"), F.lit(" ")))


def subnets(x: Column) -> Column:
    """Written CIDRs and the /24 of each private IPv4 address, sorted; octets aren't range-checked."""
    octets = lambda ip: F.split(ip, r"\.")
    first, second = lambda ip: F.get(octets(ip), F.lit(0)).cast("int"), lambda ip: F.get(octets(ip), F.lit(1)).cast("int")
    private = F.filter(matches(x, IPV4, 1), lambda ip: (first(ip) == 10) | ((first(ip) == 172) & second(ip).between(16, 31)) | ((first(ip) == 192) & (second(ip) == 168)))
    return F.array_sort(F.array_union(matches(x, CIDR, 1), F.transform(private, lambda ip: F.concat(F.regexp_extract(ip, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24")))))


def file_paths(x: Column) -> Column:
    found = F.concat(*[matches(x, p) for p in PATHS])
    cut = F.transform(found, lambda v: F.rtrim(strip(v), F.lit(".,;:!)")))
    return sorted_set(F.filter(cut, lambda v: F.length(v) >= 4))


def registry_keys(x: Column) -> Column:
    keys = F.transform(matches(x, REGISTRY_KEY), lambda v: F.rtrim(v, F.lit(".,;:")))
    return F.array_sort(F.array_union(keys, matches(x, REGISTRY_VALUE, 1)))


def marker_extensions(x: Column) -> Column:
    """Appended or renamed-to extensions, with their dot, without common ones."""
    ext = F.transform(matches(x, EXTENSION, 1), lambda v: F.lower(v))
    kept = F.filter(ext, lambda v: (F.length(v) >= 3) & ~v.isin(*EXTENSION_STOPLIST))
    return sorted_set(F.transform(kept, lambda v: F.concat(F.lit("."), v)))


def cve_key(reference: Column, name: Column, description: Column) -> Column:
    """CVE id of the reference, else found in the name, else in the description; upper case, null if none."""
    found = lambda c: F.nullif(F.regexp_extract(c, CVE, 0), F.lit(""))
    return F.upper(F.coalesce(F.nullif(F.trim(reference), F.lit("")), found(name), found(description)))


def scrub(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), SECRET, "sk-***")


def strip_markers(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), OUTPUT_MARKER, ""), r"\s+$", "")


def truncate(x: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 1), F.lit("…"))).otherwise(x)


def secret_key(name: Column) -> Column:
    """Whether a setting of this name holds a secret; names of environment variables don't."""
    return name.rlike(SECRET_KEY) & ~F.lower(name).endswith("_env")


def without_secrets(m: Column) -> Column:
    """A map without the settings that are named like secrets; for nested values see :func:`operators.jsontree.without_secrets`."""
    return F.map_filter(m, lambda k, v: ~secret_key(k))


#: Endings of inflected verbs and what may stand in their place in the base form.
VERB_ENDINGS = (("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ed", ""), ("d", ""), ("ing", ""), ("ing", "e"))
#: Forms that no rule gives.
IRREGULAR_VERBS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "did": "do", "done": "do", "went": "go", "gone": "go", "ran": "run", "wrote": "write", "written": "write",
    "saw": "see", "seen": "see", "said": "say", "made": "make", "took": "take", "taken": "take", "got": "get", "gave": "give", "given": "give", "found": "find", "sent": "send", "stole": "steal", "stolen": "steal",
    "hid": "hide", "hidden": "hide", "began": "begin", "begun": "begin", "built": "build", "led": "lead", "left": "leave", "kept": "keep", "lost": "lose", "met": "meet", "told": "tell", "thought": "think",
}


def base_forms(word: Column) -> Column:
    """What the base form of an English verb may be: the word itself, what the rules of endings give (with a doubled last letter halved), and its irregular base."""
    w = F.lower(word)
    cut = [F.when(F.endswith(w, F.lit(e)) & (F.length(w) > len(e) + 1), F.concat(F.substring(w, F.lit(1), F.length(w) - len(e)), F.lit(r))) for e, r in VERB_ENDINGS]
    halved = [F.regexp_replace(c, r"([b-df-hj-np-tv-z])\1$", "$1") for c in cut[4:7]]
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR_VERBS.items() for x in kv])[w]
    return F.array_distinct(F.array_compact(F.array(w, *cut, *halved, irregular)))


def form_of(word: Column, verbs: tuple[str, ...]) -> Column:
    """Whether a word is a form of one of the verbs (base forms)."""
    return F.arrays_overlap(base_forms(word), F.array(*map(F.lit, verbs)))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.?!])\s+"), lambda s: strip(s)), lambda s: s != "")


def error_class(message: Column, status: Column) -> Column:
    """auth, gateway, unknown_model, capacity, truncated, malformed or other."""
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(m.contains("failure to get a peer from the ring-balancer"), "gateway")
        .when(m.rlike(r"[Tt]he model [`'\"]?[\w./:-]+[`'\"]? (?:does not exist|is not available)"), "unknown_model")
        .when(m.contains("is temporarily at capacity"), "capacity")
        .when(m.contains("Incorrect API key provided") | (status == 401), "auth")
        .when(m.rlike("(?i)max_tokens|truncated"), "truncated")
        .when(m.rlike("(?i)parse|malformed"), "malformed")
        .otherwise("other")
    )


def transient(message: Column, status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | F.coalesce(message, F.lit("")).contains("at capacity")


def kilobytes(size: Column) -> Column:
    return F.format_string("%.1f KB", size / 1024.0)


def estimate_tokens(x: Column) -> Column:
    return F.floor(F.length(F.coalesce(x, F.lit(""))) / 4).cast("long")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def light_html(x: Column) -> Column:
    """Markup as HTML: text is escaped, ``**bold**`` becomes strong, ``- item`` and ``• item`` lines become nested lists, two blanks a level, other lines paragraphs; a blank line ends lists.

    The tags of a line follow from its depth and that of the line before, so all are written side by side.
    """
    safe = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    bold = F.regexp_replace(safe, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    lines = F.split(bold, r"\r?\n")
    item = r"^(\s*)[-•]\s+(.*)$"
    depth = lambda s: F.when(s.rlike(item), F.greatest(F.lit(1), F.floor(F.length(F.regexp_extract(s, item, 1)) / 2).cast("int") + 1)).otherwise(F.lit(0))
    with_depth = F.transform(lines, lambda s: F.struct(s.alias("s"), depth(s).alias("d")))
    up, down = lambda n: F.repeat(F.lit("<ul>"), n), lambda n: F.repeat(F.lit("</li></ul>"), n)

    def written(line, i):
        d, last = line["d"], F.when(i > 0, F.get(with_depth, i - 1)["d"]).otherwise(0)
        tags = F.when(d == 0, down(last)).when(d > last, up(d - last)).otherwise(F.concat(down(last - d), F.lit("</li>")))
        body = F.when(d > 0, F.concat(F.lit("<li>"), F.regexp_extract(line["s"], item, 2))).when(strip(line["s"]) != "", F.concat(F.lit("<p>"), strip(line["s"]), F.lit("</p>"))).otherwise("")
        return F.concat(tags, body)

    ends = down(F.element_at(with_depth, -1)["d"])
    return F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.array_join(F.transform(with_depth, written), ""), ends))


def preview(values: Column, k: int) -> Column:
    """The first k values, then how many more there are."""
    more = F.size(values) - k
    return F.concat(F.array_join(F.slice(values, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" … +"), more.cast("string"))).otherwise(""))
