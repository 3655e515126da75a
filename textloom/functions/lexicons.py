"""Word lists and character tables. Results depend on exactly these."""

from __future__ import annotations

# English function words (tokens are lower-cased, so "I" never matches and is left out).
FUNCTION_WORDS = (
    "the a an this that these those is am are was were be been being have has had do does did "
    "will would shall should may might can could must not and but or nor for yet so in on at to with by from of about "
    "if then than because while although though he she it they we you me him her us them my your his its our their "
    "who whom which what where when how why"
).split()

# Discourse markers, found as substrings.
DISCOURSE_MARKERS = [
    "however", "therefore", "moreover", "furthermore", "nevertheless", "consequently", "additionally", "meanwhile", "nonetheless",
    "in conclusion", "in summary", "for example", "for instance", "on the other hand", "in contrast", "as a result", "in addition",
    "first", "second", "third", "finally", "lastly", "indeed", "certainly", "clearly", "obviously", "apparently",
]

# Pronouns, modal verbs, conjunctions.
MODAL_VERBS = "can could may might must shall should will would".split()
PRONOUNS_FIRST = "i me my mine myself we us our ours ourselves".split()
PRONOUNS_SECOND = "you your yours yourself yourselves".split()
PRONOUNS_THIRD = "he him his himself she her hers herself it its itself they them their theirs themselves".split()
CONJUNCTIONS = "and but or nor for yet so because although while if unless until since after before".split()

# Transition families, found as substrings.
TRANSITIONS = {
    "addition": ["additionally", "furthermore", "moreover", "also", "besides", "in addition"],
    "contrast": ["however", "nevertheless", "nonetheless", "conversely", "on the other hand", "in contrast", "yet", "but"],
    "cause": ["therefore", "consequently", "thus", "hence", "as a result", "because"],
    "sequence": ["first", "second", "third", "next", "then", "finally", "lastly", "subsequently"],
    "example": ["for example", "for instance", "specifically", "namely", "such as"],
    "conclusion": ["in conclusion", "in summary", "to summarize", "overall", "in short"],
}

# Look-alike characters and what they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "β": "b", "ο": "o", "ν": "v", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "０": "0", "１": "1", "２": "2", "３": "3", "４": "4", "５": "5", "６": "6", "７": "7", "８": "8", "９": "9",
}

# Invisible characters and their names.
ZERO_WIDTH = {
    "\u200b": "ZERO_WIDTH_SPACE",
    "\u200c": "ZERO_WIDTH_NON_JOINER",
    "\u200d": "ZERO_WIDTH_JOINER",
    "\u2060": "WORD_JOINER",
    "\ufeff": "ZERO_WIDTH_NO_BREAK_SPACE",
    "\u00ad": "SOFT_HYPHEN",
    "\u200e": "LEFT_TO_RIGHT_MARK",
    "\u200f": "RIGHT_TO_LEFT_MARK",
}

# Synonyms by word.
SYNONYMS = {
    "important": ["crucial", "essential", "vital", "significant", "key"],
    "show": ["demonstrate", "illustrate", "exhibit", "reveal", "display"],
    "use": ["utilize", "employ", "leverage", "apply", "harness"],
    "help": ["assist", "aid", "facilitate", "support"],
    "make": ["generate", "produce", "create", "construct"],
    "good": ["favorable", "advantageous", "beneficial", "sound"],
    "bad": ["adverse", "detrimental", "unfavorable", "suboptimal"],
    "often": ["frequently", "commonly", "typically", "routinely"],
    "fast": ["rapid", "swift", "expeditious", "speedy"],
    "slow": ["gradual", "deliberate", "measured", "unhurried"],
    "furthermore": ["moreover", "in addition", "additionally", "what is more"],
    "consequently": ["as a result", "therefore", "thus", "accordingly"],
    "however": ["nevertheless", "yet", "nonetheless", "conversely"],
    "in conclusion": ["to summarize", "in summary", "overall", "to conclude"],
}

# Sentence openers, formal openers, formal words, and the keywords of the rule score.
FILLERS = ["Honestly,", "To be fair,", "In reality,", "As it turns out,", "Interestingly enough,", "Frankly speaking,", "Mind you,", "In practice,"]
FORMAL_OPENERS = ["furthermore", "moreover", "in conclusion", "consequently", "additionally", "in summary", "subsequently", "importantly"]
BUZZWORDS = "tapestry delve testament crucial multifaceted pivotal holistic seamlessly underscores intertwined fosters empowers unwavering paramount nuanced".split()
RULE_KEYWORDS = ["furthermore", "moreover", "in conclusion", "consequently", "pivotal", "subsequently", "specifically", "therefore", "essential", "delve", "crucial", "holistic", "landscape", "testament"]

# Labels of external corpora, and the value domains of the canonical table.
LABEL_ORIGIN = {"human": "HUMAN", "ai": "AI_RAW", "machine": "AI_RAW", "generated": "AI_RAW"}
ORIGINS = ["HUMAN", "AI_RAW", "AI_HUMANIZED", "AI_PARAPHRASED", "HUMAN_EDITED_AI", "HUMAN_PARAPHRASED", "ADVERSARIAL_AI", "MIXED_AUTHORED"]
DOMAINS = ["ACADEMIC", "NEWS", "ESSAY", "TECHNICAL", "BUSINESS", "CREATIVE", "SOCIAL_MEDIA", "OTHER"]
SEVERITIES = ["NONE", "LIGHT", "MEDIUM", "HEAVY", "UNKNOWN"]
