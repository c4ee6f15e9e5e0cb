"""Settings that the operators take as defaults; each is a parameter where it is used."""

from __future__ import annotations

LEVEL_WORDS = {"beginner": 800, "intermediate": 1500, "advanced": 2500}
DEFAULT_LEVEL = "intermediate"
MIN_SECTION_WORDS = 200
WORDS_PER_MINUTE = 200
PAGE_WORDS = 250
GREEDY_PAGE_WORDS = 500
QUESTIONS_PER_CHAPTER = 3
VOCABULARY_PER_CHAPTER = 8
TASK_TIMEOUT_MINUTES = 15
GRADE_PREFIX = "grade-"


def level_target(level: str) -> tuple[int, int]:
    """Least and greatest words of a section at a level: the level's words less and plus a fifth."""
    words = LEVEL_WORDS.get(level, LEVEL_WORDS[DEFAULT_LEVEL])
    return int(words * 0.8), int(words * 1.2)
