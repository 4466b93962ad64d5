"""Fixed values.

Every list below is a constant whose exact content decides results: term lists, lookup
tables, patterns. They are stated plainly, in their natural order, and all operators take
them as parameters so other lexicons can be passed (the generated test text contains none
of the built-in terms, see FIXTURES.md §3).
"""
from __future__ import annotations

# ---------------------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------------------

# Domain order: ties between domains go to the first in this order (rule P6).
DOMAIN_ORDER = ["technical", "medical", "legal", "financial"]

# Whitespace of Python's str.split(): runs of these characters separate words (rule P1).
# Written as a regex class that Java regex and RE2 (DuckDB) read the same way.
WS_REGEX = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")

# The same characters as a class body, for "not whitespace" classes.
WS_CLASS = (r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# All other characters, as a Java regex class: it tests the printable ASCII ones first, which most are (a
# negated WS_CLASS tests every range for each character, and takes several times as long).
WORD_CLASS = (r"[\x{21}-\x{7E}[\x{0}-\x{8}\x{E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
              r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]]")

# The white space as a plain string (for `trim(str, chars)`, which strips any of them).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

# Characters stripped from both ends of a keyword (rule P2).
KEYWORD_STRIP = ".,!?;:"

# Short stop-word set of the keyword extractor (F1).
KEYWORD_STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
                     "of", "with", "by"]

# Knowledge concepts per domain, substring match on lower-cased text.
KNOWLEDGE_CONCEPTS = {
    "technical": ["api", "database", "algorithm", "framework", "architecture", "security"],
    "medical": ["diagnosis", "treatment", "patient", "clinical", "therapeutic", "syndrome"],
    "legal": ["contract", "liability", "regulation", "compliance", "statute", "jurisdiction"],
    "financial": ["investment", "portfolio", "risk", "return", "valuation", "market"],
}

# Feedback concepts: all four lists in this order, first five hits kept.
FEEDBACK_CONCEPTS = {
    "technical": ["api", "database", "algorithm", "architecture", "performance"],
    "medical": ["diagnosis", "treatment", "symptoms", "medication", "therapy"],
    "legal": ["contract", "compliance", "regulation", "liability", "jurisdiction"],
    "financial": ["investment", "portfolio", "risk", "return", "market"],
}

# Content domain indicators: occurrences of each term, weight 1/len(list).
CONTENT_DOMAIN_TERMS = {
    "technical": ["API", "algorithm", "framework", "database", "deployment", "architecture",
                  "performance", "security"],
    "medical": ["patient", "clinical", "diagnosis", "treatment", "medical", "healthcare",
                "symptom", "therapy"],
    "legal": ["contract", "legal", "statute", "compliance", "regulation", "court",
              "jurisdiction", "liability"],
    "financial": ["investment", "portfolio", "market", "financial", "risk", "return", "asset",
                  "valuation"],
}

# File-name indicators: +1.0 per pattern found in the lower-cased name.
FILENAME_DOMAIN_PATTERNS = {
    "technical": ["api", "tech", "system", "code", "dev", "software"],
    "medical": ["medical", "clinical", "health", "patient", "drug"],
    "legal": ["legal", "law", "contract", "compliance", "regulation"],
    "financial": ["finance", "investment", "market", "bank", "economic"],
}

# File name → first domain with any of these terms.
FILENAME_DOMAIN_TERMS = {
    "technical": ["tech", "software", "code", "programming", "api", "system", "architecture"],
    "medical": ["medical", "health", "patient", "clinical", "diagnosis", "treatment", "pharma"],
    "legal": ["legal", "law", "contract", "compliance", "regulation", "policy", "court"],
    "financial": ["financial", "finance", "banking", "investment", "market", "economic",
                  "trading"],
}

# Test lexicon of FIXTURES.md §3 (the generated prose contains none of the terms above).
TEST_LEXICON = {
    "technical": ["thatin", "ononst", "thble"],
    "medical": ["inoran", "hehely", "thing"],
    "legal": ["orantion", "thtion", "nicht"],
    "financial": ["eaux", "ción", "que"],
}

# Fixture parameters (FIXTURES.md).
AS_OF = "2024-01-31 00:00:00"
