"""Character classes shared by every expression.

Written so that Java and RE2 read them alike: ``\\x{h}`` escapes, ``\\p{..}``
classes, and no reliance on what ``\\s``, ``\\w`` or ``\\d`` mean to an engine.
"""

# Unicode white space, plus the four ASCII separators Python counts as space.
# Single characters and one category: both engines test these fastest.
INLINE_CHARS = r"\t\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f} \x{85}\p{Z}"
INLINE = f"[{INLINE_CHARS}]"
SPACE_CHARS = r"\n" + INLINE_CHARS
SPACE = f"[{SPACE_CHARS}]"
# The same characters one by one, for trimming.
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CHARS = r"\p{L}\p{N}_"
CJK_CHARS = r"\x{4e00}-\x{9fff}"
DIGIT = r"\p{Nd}"
NUMERALS = "一二三四五六七八九十"

STRIP = f"^{SPACE}+|{SPACE}+$"
# One class first, so that Java asks a character once (Java only).
LINE_BREAK = r"[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}-\x{2029}](?:(?<=\r)\n)?"
BLANK_LINE = rf"\n{SPACE}*\n"

# Characters that do not count as garbled.
NORMAL_CHARS = (
    r"\w" + SPACE_CHARS + CJK_CHARS
    + "，。！？、；：（）【】《》"
    + r",.!?;:'\"()\[\]{}<>\-+*/=#@%&~`"
)
