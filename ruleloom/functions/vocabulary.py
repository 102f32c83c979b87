"""Values that results depend on: closed label sets, word lists and patterns. Fixed values, stated plainly.

Patterns are written with ASCII word borders (B before and E after a word) because Java's \\b also counts letters
beyond ASCII. They use no flags but a leading (?i). Where few letters can begin a match, a look at the first letter comes
before the border: it changes no match, and passes over other places for a fraction of the border's time.
"""

from __future__ import annotations

from dataclasses import dataclass

B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Closed label sets.
STATUSES = ("proposed", "final", "amended", "notice")
DISPOSITIONS = ("affirmed", "sustained", "clarified", "modified", "set-aside", "unclassified")
MATERIALITIES = ("material", "clarifying", "editorial", "undecided")
VERDICTS = ("agree", "disagree", "recategorize")
CATEGORIES = ("deadline", "money", "threshold", "obligation", "definition", "other")

# Tags whose end breaks a line, whose content is no text, and the footnote mark.
BLOCK_TAGS = frozenset(("P", "HD", "FP", "FTNT", "NOTE", "EXTRACT", "GPOTABLE", "ROW", "SECTNO", "SUBJECT", "AUTH", "STARS"))
SKIPPED_TAGS = frozenset(("PRTPAGE",))
FOOTNOTE_MARK, FOOTNOTE = "SU", "FTNT"

# Numbers in words.
ONES = dict(
    zero=0, one=1, two=2, three=3, four=4, five=5, six=6, seven=7, eight=8, nine=9, ten=10, eleven=11, twelve=12,
    thirteen=13, fourteen=14, fifteen=15, sixteen=16, seventeen=17, eighteen=18, nineteen=19,
)
TENS = dict(twenty=20, thirty=30, forty=40, fifty=50, sixty=60, seventy=70, eighty=80, ninety=90)
LARGE = dict(hundred=100, thousand=1000)
NUMBER_WORD_VALUES = ONES | TENS | LARGE | {f"{t}-{o}": a + b for t, a in TENS.items() for o, b in ONES.items()}

# Patterns of the rule tier.
TYPOGRAPHIC = ("i.e.", "i.e.,", "e.g.", "e.g.,", "et seq.", "id.", "supra", "infra", "cf.", "see", "viz.")
ARTICLES = rf"(?i)(?=[at]){B}(?:the|an|a){E}"
MODALS = rf"(?i)(?=[msw]){B}(?:shall|may|must|will|should|shall not|may not){E}"
NEGATION = rf"(?i)(?=n){B}(?:(?:not|no|nor|never|non){E}|non-)"
NUMBERS = r"(?i)\$?[0-9][0-9,]*(?:\.[0-9]+)?"
NUMBER_WORDS = rf"(?i)(?=[{''.join(sorted({w[0] for w in NUMBER_WORD_VALUES}))}]){B}(?:(?:{'|'.join(TENS)})-(?:{'|'.join(ONES)})|{'|'.join(TENS)}|{'|'.join(ONES)}|hundred|thousand){E}"
CROSSREF_NUMBER = rf"(?i)(?=[aps]){B}(?:section|sections|appendix|article|attachment|part)[WS]+[0-9](?:[WS]*[.0-9])*"

# Patterns of decision blocks.
CROSSREF = rf"(?i)(?=s){B}section[WS]+([0-9]+(?:\.[0-9]+)*)"
SENTENCE_END = r"(?<=[.;:])[WS]+(?=[A-Z(])"
DIRECTIVE = rf"(?i){B}(?:we|commission){E}[^.;]{{0,80}}?{B}(?:modif|revis|amend|add|adopt|delet|remov|replac)"
DECLINING = (
    rf"(?i){B}(?:declin\w*|do(?:es)? not adopt|did not adopt|not persuaded|reject\w*|no(?:t)? (?:necessary|required)"
    rf"|rather than|instead of|existing requirements?|would read|proposed to){E}"
)
PROVISION = r"(?i)^(?:Section[WS]+)?([0-9]+(?:\.[0-9]+)*)[WS]*(?:\.|[WS])"
TERM = rf"(?=[A-Z]){B}[A-Z][a-z]+(?:[WS]+(?:[A-Z][a-z]+|of|to|the))*{E}"

# Filing deadlines.
DEADLINE_BLOCK = rf"(?i)compliance procedures?{E}"
DEADLINE_DIRECTIVE = rf"(?i){B}(?:we|the Commission){E}[^.]{{0,120}}?{B}(?:require|direct|will require|are requiring){E}"
DEADLINE_REPORTED = rf"(?i){B}(?:suggests?|urges?|argues?|would be more appropriate|in calculating){E}"
DEADLINE_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "fifteen": 15, "eighteen": 18, "twenty": 20, "thirty": 30, "forty-five": 45, "sixty": 60, "ninety": 90,
    "one hundred eighty": 180,
}
DEADLINE_PERIOD = (
    rf"(?i){B}within[WS]+((?:[0-9]+|{'|'.join(DEADLINE_WORDS)}))[WS]+(?:calendar[WS]+|business[WS]+)?(days?|months?|years?){E}"
)
ANCHOR_PUBLICATION = rf"(?i){B}publication date{E}|{B}date of publication{E}|{B}published in the Federal Register{E}"
ANCHOR_EFFECTIVE = rf"(?i){B}effective date{E}|{B}becomes effective{E}"

# Administrative headings, after their enumerator.
ENUMERATOR = r"(?i)^[WS]*(?:[IVXLC]+|[A-Z]|[0-9]+)[.)][WS]*"
ADMINISTRATIVE = (
    r"^table of contents", "information collection", "paperwork reduction", "environmental analysis", "environmental assessment",
    "regulatory flexibility", r"comment procedures?", "filing comments", "document availability", "congressional review",
    r"^effective dates?", r"compliance procedures?", "executive order", r"^signature", r"^list of subjects",
)

# Signals of categories, the strongest first.
SIGNALS = {
    "deadline": (
        rf"(?i){B}(?:[0-9]+|\([0-9]+\))[WS]*(?:calendar|business|working)[WS]+days?{E}",
        rf"(?i){B}(?:calendar|business|working)[WS]+days?{E}",
        rf"(?i){B}within[WS]+(?:[NWS]+[WS]+){{0,4}}?(?:days?|weeks?|months?|hours?){E}",
        rf"(?i){B}no later than{E}",
        rf"(?i){B}[0-9]+[WS]+(?:days?|weeks?|months?|years?){E}",
        rf"(?i)\([0-9]+\)[WS]*(?:days?|weeks?|months?){E}",
        rf"(?i){B}due date{E}",
        rf"(?i){B}deadline",
        rf"(?i){B}timeline",
        rf"(?i){B}window{E}",
        rf"(?i){B}processing time{E}",
    ),
    "money": (
        r"\$[0-9,]+",
        rf"(?i){B}financial security{E}",
        rf"(?i){B}security (?:deposit|arrangement|instrument)",
        rf"(?i){B}letter of credit{E}",
        rf"(?i){B}(?:non-?)?refund",
        rf"(?i){B}penalt",
        rf"(?i){B}deposit",
        rf"(?i){B}fees?{E}",
        rf"(?i){B}surety{E}",
        rf"(?i){B}costs?{E}",
        r"\$",
    ),
    "threshold": (
        rf"(?i){B}[0-9][0-9,.]*[WS]*(?:MW|kV){E}",
        rf"(?i){B}[0-9][0-9,.]*[WS]*percent{E}|{B}[0-9][0-9,.]*[WS]*%",
        rf"(?i){B}at least[WS]+[0-9]",
        rf"(?i){B}no more than[WS]+[0-9]",
        rf"(?i){B}threshold",
        rf"(?i){B}exceeds?{E}",
        rf"{B}MW{E}|{B}kV{E}|{B}percent{E}|%",
    ),
    "definition": (rf"(?i){B}shall mean{E}",),
    "obligation": (rf"(?i){B}(?:shall not|may not|must not){E}", rf"(?i){B}(?:shall|must|is required to|are required to){E}"),
}
#: The order in which a changed text is tried.
SIGNAL_ORDER = ("deadline", "money", "threshold", "definition", "obligation")
DEFINITION_TITLE = rf"(?i){B}definitions?{E}"

# Sizes that are part of the results.
CONTEXT, PASSAGE_CONTEXT, PASSAGE_CHARS, PASSAGES, CHANGED_CHARS = 60, 320, 900, 4, 6000
OUTLINE_CHARS, OUTLINE_ENTRIES, TERM_CHARS, TERM_OVERLAP, TERM_GROUPS = 2000, 12, 4000, 0.34, 6
CONFIDENT = 0.7

# What readers see for each internal key.
LABELS = {
    "tier": {"T1": "Version history", "T2": "Commission determinations", "T3": "Marked-up text (redline)"},
    "join": {"explicit": "linked by section citation", "implicit": "linked by topic match", "none": "no linked text change"},
    "provision_status": {
        "proposed": "Proposed — not yet binding", "adopted": "Amended in this order", "settled": "Upheld — unchanged", "reopened": "Reopened",
        "unknown": "Undetermined",
    },
    "disposition": {
        "affirmed": "Affirmed", "sustained": "Sustained — challenge rejected", "clarified": "Clarified — no text change", "modified": "Modified",
        "set-aside": "Set aside", "unclassified": "Not yet determined",
    },
    "priority": {"material": "Changes an obligation", "needs-review": "Needs expert review", "clarifying": "Clarifying"},
    "materiality": {"material": "Changes an obligation", "clarifying": "Clarifying", "editorial": "Editorial only", "undecided": "Needs review"},
    "stage": {
        "fetching": "Retrieving document", "parsed": "Reading document", "capabilities": "Checking available analysis",
        "determinations": "Finding Commission determinations", "redline": "Extracting marked-up changes",
        "rules": "Screening changes automatically", "model": "Assessing changes needing judgement",
        "summarise": "Summarising the important changes", "cards": "Assembling the briefing", "compliance": "Finding the compliance filing deadline",
    },
    "as_reads": {
        "proposed": "As proposed", "adopted": "As adopted", "settled": "As it stands", "reopened": "As it stood, now reopened",
        "unknown": "As printed in this document",
    },
}
OFFICIAL_URL = "https://www.federalregister.gov/d/"
# Statements of a briefing, of each category and in all.
STATEMENTS, STATEMENTS_IN_ALL = 4, 24


@dataclass(frozen=True)
class Convention:
    """How one agency marks up its documents. All patterns are Java's."""

    id: str
    agency: str
    paragraph: str
    determination: str
    legend: str
    addition: tuple[str, str, str]
    separate_statement: str


# The one registered agency's conventions.
CONVENTIONS = (
    Convention(
        id="ferc-rulemaking",
        agency="(?i)FEDERAL ENERGY REGULATORY COMMISSION",
        paragraph=r"^[WS]*([0-9]{1,4})\.[WS]",
        determination=r"Determination\z",
        legend="(?i)Deletions are in brackets and additions are in italics",
        addition=("E", "T", "03"),
        separate_statement=(
            rf"(?=[A-Z]){B}[A-Z][A-Za-z'-]+,[WS]+(?:Commissioner|Chairman)(?:,[WS]+[A-Z][A-Za-z'-]+,[WS]+Commissioner)*,[WS]+(?:concurring|dissenting)"
        ),
    ),
)
