"""Parameters of the filters; the defaults give the reference results."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases of lines about site policies.
POLICY_PHRASES = (
    "terms of use",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "use of cookies",
    "use cookies",
)
# List used when no bad-word list is given.
FALLBACK_BAD_WORDS = ("porn", "xxx", "sex")
# Stop words of the document-quality filter.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")


@dataclass(frozen=True)
class C4Quality:
    min_sentences: int = 5
    min_words_per_line: int = 5
    max_word_bytes: int = 1000  # -1: no limit
    terminal_punctuation: bool = True
    remove_citations: bool = True
    lorem_ipsum: bool = True
    javascript: bool = True
    curly_bracket: bool = True
    policy: bool = True
    policy_phrases: tuple[str, ...] = POLICY_PHRASES


@dataclass(frozen=True)
class C4Paragraph:
    min_paragraphs: int = 3
    min_bytes: int = 200


@dataclass(frozen=True)
class Gopher:
    """A zero switches its check off."""

    min_words: int = 50
    max_words: int = 100_000
    min_avg_bytes: float = 3.0
    max_avg_bytes: float = 10.0
    max_symbol_ratio: float = 0.1
    max_bullet_ratio: float = 0.9
    max_ellipsis_line_ratio: float = 0.3
    min_alpha_ratio: float = 0.8
    min_stop_words: int = 2
    stop_words: tuple[str, ...] = STOP_WORDS


@dataclass(frozen=True)
class Pipeline:
    quality: C4Quality = C4Quality()
    paragraph: C4Paragraph = C4Paragraph()
    bad_words: tuple[str, ...] = FALLBACK_BAD_WORDS
