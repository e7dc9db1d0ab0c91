"""Regex classes spelled out as code points, since engines disagree on the shorthand ones."""

#: White space: 29 code points, among them the separators 1C-1F that Java's classes leave out.
SPACE = r"[\t-\r\x1c-\x20\x85   -     　]"
#: Control characters and all white space but the plain space.
NOT_PLAIN = r"[\x00-\x1f\x7f\x85   -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: Letters, and numbers that aren't decimal digits (so Ge'ez numerals count as letters).
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_RUN = r"[^\p{L}\p{N}]+"
DIGIT = r"\p{Nd}"
# Blocks of the Ethiopic and Latin scripts.
ETHIOPIC = r"[ሀ-፿ᎀ-᎟ⶀ-⷟꬀-꬯]"
LATIN = r"[A-Za-zÀ-ɏ]"
#: Characters that composition (NFC) never changes, whatever stands beside them within this class.
COMPOSED = r"[\x00-\x7f -˿ሀ-᎟‐-‧‰-⁞]"
#: Line ends of Python's splitlines().
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"
