"""Tokens, sentinels and defaults that all operators share."""

# Markers and sentinels of the data format.
MEMORY_START, MEMORY_END, MEMORY = "<|memory_start|>", "<|memory_end|>", "<|memory|>"
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
CONTINUAL_TARGET = "NA_string_only"
IGNORE = -100
PAD_ID = 0
PAD_DOC = -1
START_ID, MEMORY_ID, END_ID, IM_START_ID, IM_END_ID = 50257, 50258, 50259, 50260, 50261

# Defaults of the parameters.
RATIO, WINDOW, OVERLAP, PACK, RANKS, SEED = 16, 1024, 256, 4096, 6, 42

# The tokenizer stand-in as one pattern that Java and RE2 read alike: white space is spelled out.
SPACE = r" \t\n\x0b\f\r"
SPECIAL_PATTERN = r"<\|memory_start\|>|<\|memory_end\|>|<\|memory\|>|<\|im_start\|>|<\|im_end\|>"
WORD_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
TOKEN_PATTERN = rf"{SPECIAL_PATTERN}|{WORD_PATTERN}"
REGION_PATTERN = r"(?s)<\|memory_start\|>(.*?)<\|memory_end\|>"
