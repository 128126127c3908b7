"""Word lists, tables and classes that decide results."""

#: The 29 code points that count as white space.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: letters, digits and the underscore make words.
WORD = r"[\p{L}\p{N}_]"
NOT_SYMBOL = WORD[1:-1] + WS[1:-1]
#: Fixed value: a tag.
HTML_TAG = r"<[^>]+>"
#: Fixed value: an entity.
HTML_ENTITY = r"&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);"
#: Fixed value: the ranges that count as emoji.
EMOJI = r"[\x{1F300}-\x{1FFFF}\x{2700}-\x{27BF}\x{FE00}-\x{FE0F}\x{2600}-\x{26FF}]+"
#: Fixed value: control characters that become spaces.
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
#: Fixed value: invisible characters that go.
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{feff}\x{ad}]"
#: ASCII forms of typographic symbols, as "symbols: form"; the ellipsis becomes three dots.
SYMBOL_FORMS = {
    "'": "‘’‚‛‹›′‵",
    '"': "“”„‟«»″‶",
    "-": "‐‑‒–—―−⁃",
    "*": "•‣",
    ".": "·",
    " ": "       　",
}
#: Stop words.
STOPWORDS = """
a an the and or but in on at to for of with by from up about into through is are was were be been being have has had do
does did will would could should may might shall can need dare ought used it its this that these those i me my we our you
your he him his she her they them their what which who whom not no nor so yet both either neither each few more most other
some such than too very just because as until while if then also
""".split()
#: Words of output formats that stay as they are (word edits; translation).
FORMAT_WORDS = "json bullet numbered paragraph sentence word words uppercase lowercase bold italic heading section list".split()
FORMAT_WORDS_BT = "json bullet numbered paragraph sentence word uppercase lowercase".split()
#: Category notations and their names.
CATEGORY_NAMES = {
    "strat_with": "Start_With", "start_with": "Start_With", "end_with": "End_With", "no_commas": "No_Commas", "all_lower": "All_Lower",
    "numerical constraints": "Numerical_Constraints", "numerical_constraints": "Numerical_Constraints", "background info": "Background_Info",
    "background_info": "Background_Info", "role playing": "Role_Playing", "role_playing": "Role_Playing",
}
#: Informal words of the tone check.
INFORMAL = "gonna wanna gotta kinda dunno lol omg".split()
#: Relation notations; all others mean at least.
RELATIONS = {
    "ge": ("at_least", "atleast", "greater_than_or_equal", "gte", ">="),
    "le": ("at_most", "atmost", "less_than_or_equal", "lte", "<="),
    "eq": ("exactly", "equal", "equals", "eq", "=="),
    "gt": ("greater_than", "gt", ">"),
    "lt": ("less_than", "lt", "<"),
}
#: Patterns of constraints stated in prompts.
MINED = (
    r"(at least|at most|exactly|no more than|no fewer than)\s+(\d+)\s+(words?|sentences?|paragraphs?|bullet points?|sections?)",
    r"(must|should)\s+(start|begin)\s+with\s+[\"']?(.+?)[\"']?[\.,]",
    r"(must|should)\s+end\s+with\s+[\"']?(.+?)[\"']?[\.,]",
    r"(include|contain|use|mention)\s+(?:the\s+)?(?:words?|keywords?)\s*[:\-]?\s*(.+?)[\.;]",
    r"(?:do not|don't|avoid|never)\s+(?:use|include|mention)\s+(?:the\s+)?(?:words?|keywords?)\s*[:\-]?\s*(.+?)[\.;]",
    r"(?:write|respond|answer)\s+(?:entirely\s+)?in\s+(lowercase|uppercase|all caps)",
    r"(?:format|write)\s+(?:as|in|using)\s+(json|bullet points?|numbered list|markdown)",
    r"(?:do not|don't|avoid)\s+(?:use|include)\s+(?:any\s+)?(commas?|periods?)",
    r"(?:include|add|end with)\s+(?:a\s+)?(?:p\.?s\.?|postscript)",
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EDGE = ".,;:!?'\"()[]{}"
