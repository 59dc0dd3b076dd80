"""Word lists, patterns and weights that results depend on. Each must stay as it is."""

# Words that say nothing about a headline's event (clustering).
STOPWORDS = (
    "a an and are as at be by for from has have how in into is it its new of on or our that the "
    "this to was we what when why will with you your via after over about now more than just "
    "announces announced launches launched introduces introducing releases released unveils "
    "unveiled says said today update updates report reports"
).split()

# Tokens, versions.
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
VERSION = r"(?<![a-z0-9])(?:v?\d+(?:\.\d+){1,3}(?:[-.]?(?:rc|alpha|beta|a|b)\.?\d*)?|b\d{4,}|[0-9a-f]{12,40})(?![a-z0-9])"
NAMED_VERSION = r"(?<![a-z0-9])[a-z][a-z\-]{1,15}?-?\d+(?:\.\d+){0,2}(?![0-9])"
NOT_A_VERSION = r"^(?:fp|int|uint|bf|q|a|h|b|l|t|v|x|sm|rtx|gtx|m|x86|arm|win|py|cuda)-?\d+$"

# Headline templates and their words.
TEMPLATE_PREFIX = (
    r"(?i)^\s*(?:\[[^\]]{1,40}\]\s*[:\-—]*\s*)+|^\s*(?:feature request|feat|rfc|bug|proposal|roadmap|"
    r"tracking issue|tell hn|ask hn|show hn)\s*[:\-—]\s*"
)
BOILERPLATE = "feature request support add adding please possible allow new roadmap rfc bug issue tracking proposal development ask tell show hn".split()

# Cue groups, in the order of their features.
CUES = {
    "bug": (
        r"\b(error|exception|traceback|crash(es|ed|ing)?|segfault|panic(ked)?|fails?|failed|failing"
        r"|failure|broken|bug|regression|hangs?|hanging|stuck|doesn'?t work|not working|stopped working"
        r"|wrong result|incorrect|corrupt(ed|ion)?|data loss|outage|is down|status code 5\d\d)\b"
    ),
    "cost_perf": (
        r"\b(slow(er|ness)?|latency|expensive|costs?|costly|pricing|price|bill(ing)?|too much memory"
        r"|memory usage|oom(killed)?|out of memory|throughput|bottleneck|takes (forever|hours|minutes)"
        r"|burn(s|ing|ed)? (through )?(tokens|credits|money)|faster)\b"
    ),
    "missing": (
        r"(\bfeature request\b|\badd support\b|\bsupport for\b|\bwould be (nice|great|useful)\b|\bi wish\b"
        r"|\bis there (a|an|any)\b|\bplease add\b|\ballow (users|us|me)?\s*to\b|\bability to\b"
        r"|\bno way to\b|\bcurrently (not|no) (possible|supported)\b|\balternatives? to\b|\bnot supported\b)"
    ),
    "friction": (
        r"\b(tedious|painful|pain point|nightmare|annoying|frustrat\w*|manual(ly)?|workaround|drives me nuts"
        r"|hard to|difficult to|confusing|struggl\w*|cumbersome|boilerplate|toil|every time i)\b"
    ),
    "how_to": (
        r"(^|\b)(how (do|can|should|would) (i|we|you)|how to|what is the best way|best practices?"
        r"|any (advice|recommendations|suggestions)|what should i use)\b"
    ),
    "praise_or_chat": (
        r"\b(great (post|read|article|writeup|work)|thanks for sharing|love (this|it)|very cool|nice work"
        r"|congrat\w*|i built|show hn|what are you (working on|doing))\b"
    ),
}
LABELS = "bug_or_reliability cost_or_performance missing_capability workflow_friction how_to_question not_a_problem".split()

# Query parameters that identify a referrer; those that begin with utm_ are dropped too.
TRACKING = (
    "fbclid gclid dclid msclkid yclid twclid mc_cid mc_eid igshid ref ref_src ref_url source cmpid "
    "_hsenc _hsmi mkt_tok guccounter guce_referrer guce_referrer_sig amp output"
).split()

# Words of a query that ask for recent items.
RECENCY = r"(?i)\b(latest|newest|new|today|yesterday|this week|this month|just (?:released|announced)|breaking|now)\b"

# Map labels: words, and words that name no topic.
MAP_WORD = r"[a-z][a-z0-9.+#-]{2,}"
MAP_STOPWORDS = (
    "the and for with from that this your you are was were will can not but its into over about "
    "how why what when who new now just more than all our out has have had use using used via "
    "ask show tell github com www http https release releases introducing announcing launch "
    "launches launched says said make makes made get gets based one two first after before "
    "without while their they them his her it's i'm don't isn't we're you're here there where "
    "which also some any may might should would could does did doing done very much many most "
    "other another such only own same then too ever still even back off like want need "
    "techcrunch blog verge register amazon web services aws nvidia technical source support add file "
    "feature request issue update version latest"
).split()

# Pair scorers: intercept, centre of the cosines, weights, threshold.
STORY_SCORER = {
    "intercept": -3.5, "cosine_center": 0.85, "threshold": 0.5,
    "max_member_cosine": 30.0, "centroid_cosine": 0.0, "minhash_jaccard": 4.0, "title_jaccard": 3.0,
    "entity_jaccard": 2.0, "hours_gap": -0.03, "same_source": -2.0, "version_conflict": -6.0,
}
PROBLEM_SCORER = {
    "intercept": -0.8, "cosine_center": 0.84, "threshold": 0.6,
    "max_member_cosine": 25.0, "centroid_cosine": 0.0, "minhash_jaccard": 3.0, "title_jaccard": 4.0,
    "entity_jaccard": 2.0, "hours_gap": -0.02 / 24.0, "same_source": 0.0, "version_conflict": -10.0,
}
SAME_AUTHOR_LOGIT = -2.0

# Demand: category weights and the weight of any other.
CATEGORY_WEIGHTS = {"missing_capability": 1.2, "workflow_friction": 1.15, "cost_or_performance": 1.1, "bug_or_reliability": 1.0}
OTHER_CATEGORY = 0.8

# Rerank features in order.
RERANK_FEATURES = (
    "rrf lex_rr dense_rr lex_score dense_sim title_cover title_phrase entity_cover q_entities version_match "
    "q_version q_tokens log_sources log_articles max_authority log_hn_points freshness_7d recency_x_fresh log_words feed_share"
).split()
