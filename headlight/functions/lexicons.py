"""Word lists, patterns, weights and texts that results must equal."""

STOPWORDS = (
    "a an and are as at be but by for from has have he in is it its of on or that the to was were will with this these those you your they "
    "their we our about after before into than then them who what when where why how can could should would may might also not no yes if else because"
).split()
POSITIVE = "good great win wins success safe secure improve improved benefit benefits trusted calm hope positive better best".split()
NEGATIVE = "bad worse worst risk danger dangerous fear angry hate scam fraud hoax crisis shock shocking panic urgent warning exposed".split()
#: (pattern on the lower-cased title, its label); \b is ASCII, so written as lookarounds in Spark.
BAIT = [
    ("you won't believe", "you won't believe"), ("what happened next", "what happened next"), ("shocking", "shocking"), ("mind.?blowing", "mindblowing"),
    ("this one trick", "this one trick"), ("secret", "secret"), ("doctors hate", "doctors hate"), ("gone wrong", "gone wrong"), ("won't believe", "won't believe"),
    ("instantly", "instantly"), ("guaranteed", "guaranteed"), ("must see", "must see"), ("exposed", "exposed"), ("you need to see", "you need to see"),
    ("this is why", "this is why"), ("number [0-9]+", "number d"), (r"\b(top|best|worst)\s+[0-9]+", "topbestworst d"),
]
DECEPTION = [(x, x) for x in ("miracle", "cure", "100%", "proof", "the truth about", "they don't want you to know", "conspiracy", "hoax")]
TEASERS = "unbelievable shocking secret exposed truth must incredible".split()
NOISE = ["gtm", "googletag", "datalayer", "pageview", "event", "client_id", "widget", "cookie", "consent", "analytics", "json", "schema", "script"]
BOILERPLATE = "cookie|consent|privacy policy|terms of use|all rights reserved|subscribe|sign in|log in|disclaimer"
CUES = "[0-9]|claim|said|report|according|announced|confirmed|study"
PRUNE_TAGS = "script style noscript svg iframe form nav footer header aside".split()
PRUNE_CLASSES = ["advertisement", "ad"]
PRUNE_PARTS = {"id": "ad- cookie consent analytics tracking share related comment".split(), "class": "ad- ads cookie consent analytics tracking share related comment".split()}
BODY_SELECTORS = ["article", "main", "[role='main']", ".article", ".post-content", ".entry-content", ".story-content", ".content"]
W = {"bait": 14, "deception": 10, "mark": 4, "bang_cap": 12, "ask_cap": 10, "upper": 10, "length": 6, "gap": 18, "tone": 12, "teaser": 12, "synergy": 6, "none": 65, "risky": 70, "warning": 40}
GAP_AT, TONE_AT, UPPER_AT = 0.35, 0.5, 0.45
SIGNALS = {
    "bait": 'Headline matches pattern: "%s"', "deception": 'Potential deceptive cue found: "%s"', "bang": "Headline uses high-emphasis punctuation.",
    "ask": "Headline is framed as a suspense question.", "upper": "Headline has excessive uppercase emphasis.", "length": "Headline length is unusual for balanced reporting.",
    "gap": "Low lexical overlap between headline and body suggests a semantic gap.", "tone": "Headline sentiment intensity is unusually high.",
    "teaser": "Headline teases claims not echoed in the article body.", "synergy": "Combined hook language and weak body support increased risk.",
    "none": "Could not extract a reliable headline from the page.",
}
HOOKS = [
    ("you won't believe|won't believe", "Suspense bait phrase in headline."), ("shocking|mind.?blowing|unbelievable", "Extreme emotional adjective detected."),
    ("secret|exposed|truth about", "Curiosity-gap wording detected."), (r"\b(top|best|worst)\s+[0-9]+\b|\b[0-9]+\s+reasons\b", "Listicle hype pattern detected."),
    ("!+|[?]+", "Emphatic punctuation suggests sensational framing."),
]
#: Errors of a fetched page; %s is its status.
STATUS_ERRORS = {
    "blocked": "The site blocked our request (HTTP %s). Many large news sites sit behind bot protection that refuses automated readers.",
    "limited": "The site is rate-limiting automated requests (HTTP 429). Try again in a little while.", "failed": "Failed to fetch article: HTTP %s",
    "no_html": "The address is not an HTML page.",
}
ACQUIRE_ERRORS = {
    "robots": "This site disallows automated fetching in its robots.txt, and no readable archive copy was available.",
    "none": "Could not extract a readable article (tried direct fetch, AMP, headless browser, and web archive).", "hint": " A public archive snapshot exists: ",
    "body": "Could not extract enough article body text.",
}
#: Address ranges that must not be fetched, by the names that the first engine gives them; IPv6 below IPv4. Multicast may be.
UNSAFE_RANGES = {
    "unspecified": "0.0.0.0/8 ::/128", "broadcast": "255.255.255.255/32", "linkLocal": "169.254.0.0/16 fe80::/10", "loopback": "127.0.0.0/8 ::1/128", "carrierGradeNat": "100.64.0.0/10",
    "private": "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16", "uniqueLocal": "fc00::/7",
    "reserved": "192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 2001:db8::/32",
}
#: The second engine: selectors of the body's blocks, labels of entity groups, and its engine's name without a model.
BLOCK_SELECTORS = ["article", "main", "[role='main']", ".post-content", ".entry-content"]
ENTITY_LABELS = "ORG PERSON GPE DATE PRODUCT MONEY EVENT NORP".split()
