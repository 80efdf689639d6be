"""Fixed values that must equal the behaviour being reproduced. Kept together, in natural order."""

# --- fixed values: Penn Treebank bracket escapes, (raw, escaped), applied in this order ---
PTB_ESCAPES = [
    ("(", "-LRB-"),
    (")", "-RRB-"),
    ("[", "-LSB-"),
    ("]", "-RSB-"),
    ("{", "-LCB-"),
    ("}", "-RCB-"),
]

# --- fixed values: ASCII punctuation (Python's string.punctuation) ---
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The same 32 characters as a regex class: ranges 0x21-0x2F, 0x3A-0x40, 0x5B-0x60, 0x7B-0x7E.
ASCII_PUNCT_CLASS = "[!-/:-@\\[-`{-~]"

# --- fixed values: the common English stop-word list (179 words) used by the matchers ---
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]
STOPWORDS_AND_PUNCT = ENGLISH_STOPWORDS + list(ASCII_PUNCT)

# --- fixed values: the characters that count as white space around a word (Unicode's and the ASCII separators) ---
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: scoring constants ---
LEXICAL_THRESHOLD = 0.5      # M1/M2 coverage must exceed this
BLEU_THRESHOLD = 0.4         # M5
PUNISH_M = 0.95              # F6 copy penalty starts above this score
PUNISH_LOW = 0.85            # F6 value reached at a score of 1
HIGH_SCORE = 0.6             # A11 "high" score
SIGMOID_SCALE = 6.0          # F3: similarity = 2 * (sigmoid(6 d) - 1/2)
MINMAX_EPS = 1e-3            # A5: ((c - min) + eps) / (max - min + 2 eps)
FUZZY_MIN_SCORE = 70         # E5 fuzzy candidates must score above this
