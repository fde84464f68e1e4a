"""Fixed values of the narration rules, in the order in which they apply.

Every value here decides the result text, so none of them may be changed
without changing what the library computes.  Patterns are Java regular
expressions.  ``(?U)`` makes ``\\s`` mean Unicode white space; ``[0-9]`` and
``[A-Z]`` stay ASCII under it.
"""

# --- footnote markers, removed from the raw HTML -----------------------------
# The marker is `<sup[^>]*>\s*[0-9]+\s*</sup>`.  The first alternative takes any
# other <sup> tag as a whole and puts it back, so a page of unfinished tags is
# read once and not from each of them to its end.
FOOTNOTE_MARKER = (
    r"(?U)(<sup[^>]*+(?:>(?!\s*+[0-9]++\s*+</sup>)|\z))|<sup[^>]*+>\s*+[0-9]++\s*+</sup>"
)
FOOTNOTE_TEXT = "$1"

# --- clean-up ----------------------------------------------------------------
BREAK_MARK = "@BRK#"
BREAK_TEXT = "."
# White space up to a newline becomes that newline.  The rule is `\s*\n`; this
# spelling finds the same places but starts only at the head of a run and skips
# a lone newline (which would be replaced by itself), so it takes linear time.
BLANKS_BEFORE_NEWLINE = r"(?U)\s(?<!\s\s)\s*\n"
# True where the rule above has something to do; tests newlines only.
HAS_BLANK_BEFORE_NEWLINE = r"\n(?<=(?U:\s)\n)"

# --- amounts of money --------------------------------------------------------
SINGLE_DOLLAR_AT_END = r"\$1\z"
SINGLE_DOLLAR_WORDS = "one dollar"
LARGE_AMOUNT = r"(?U)\$([1-9][.]*[0-9]*\s(million|billion|trillion))"
PLAIN_AMOUNT = r"\$([,0-9]+)"
AMOUNT_WORDS = "$1 dollars"

# --- speeds: unit letter and the word it stands for --------------------------
SPEED_UNITS = (("k", "kilometers per hour"), ("m", "miles per hour"))
SPEED_HINTS = ("kph", "mph", ".p.h.")

# --- names -------------------------------------------------------------------
# `\w` is ASCII here: letters, digits and the underscore.
NOT_FILENAME_SAFE = r"[^\w.\-/]"
FILENAME_FORMAT = "%04d_%s"
USABLE_TITLE_MIN_BYTES = 3
IGNORED_TITLE_TAG = "Cover"

# --- rule file ---------------------------------------------------------------
RULE_COMMENT = "#"
RULE_SEPARATOR = "=="

# --- book outputs ------------------------------------------------------------
ENV_SCRIPT_FORMAT = (
    "#!/bin/bash\n"
    ' export BOOK_TITLE="%s" \n'
    ' export BOOK_AUTHOR="%s" \n'
    ' export BOOK_COVER="cover" \n'
)
JPEG_MIME = "image/jpeg"
JPEG_EXTENSION = "jpg"
OTHER_COVER_EXTENSION = "png"

# --- audio manifest ----------------------------------------------------------
AUDIO_FILE = r"(?s)\A[^.].*\.wav\z"
AUDIO_STEM = r"(?s)\A(.*?)\.txt\.wav"
COVER_COMMENT = "Cover (front)"
