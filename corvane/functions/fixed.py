"""Formats, names and numbers that results must reproduce."""

# --- Fixed values: record keys ----------------------------------------------
CANONICAL_KEYS = (
    "prompt",
    "completion",
    "instruction",
    "input",
    "output",
    "response",
    "messages",
    "text",
)

# --- Fixed values: prompt and transcript layout ------------------------------
INSTRUCTION_HEAD = "### Instruction:\n"
RESPONSE_HEAD = "### Response:\n"
INPUT_HEAD = "### Input:\n"
OUTPUT_HEAD = "### Output:\n"
PROMPT_HEAD = "### Prompt:\n"
TRANSCRIPT_TITLE = "Conversation Log"
RULE_WIDTH = 80

# --- Fixed values: characters a full strip removes ---------------------------
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: default tokenizer -----------------------------------------
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
PAD_TOKEN, UNK_TOKEN = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1
IGNORED_LABEL = -100

# --- Fixed values: scoring ---------------------------------------------------
# profile -> (metric, weight); "v3" is the current profile.
WEIGHTS = {
    "v1": (
        ("MCQ Accuracy", 0.35),
        ("BERTScore", 0.25),
        ("ROUGE-L", 0.15),
        ("Perplexity", 0.25),
    ),
    "v2": (
        ("MCQ Accuracy", 0.40),
        ("BERTScore", 0.30),
        ("ROUGE-L", 0.20),
        ("Perplexity", 0.10),
    ),
    "v3": (
        ("BERTScore", 0.30),
        ("ROUGE-L", 0.40),
        ("Consistency", 0.15),
        ("High Quality %", 0.10),
        ("Perplexity", 0.05),
    ),
}
PERPLEXITY_DECAY = {"v2": 300.0, "v3": 250.0}
EMPTY_PERPLEXITY = 100.0
EMPTY_QUALITY = 50.0
HIGH_QUALITY_FLOOR = 70.0
GRADES = (
    (90.0, "A+ (Excellent)"),
    (85.0, "A  (Very Good)"),
    (80.0, "B+ (Good)"),
    (75.0, "B  (Above Average)"),
    (70.0, "C+ (Average)"),
    (65.0, "C  (Below Average)"),
    (60.0, "D  (Poor)"),
)
LOWEST_GRADE = "F  (Needs Improvement)"
# metric -> (low bound, message below it, high bound, message from it on)
ADVICE = {
    "bert_score": (
        75.0,
        "Semantic quality is low - model may not understand context well",
        85.0,
        "Strong semantic understanding",
    ),
    "rouge_score": (
        15.0,
        "Low content overlap - responses may be too different from references",
        25.0,
        "Good content coverage",
    ),
    "consistency": (
        60.0,
        "Low consistency - model responses vary significantly in quality",
        80.0,
        "Highly consistent responses",
    ),
    "perplexity_score": (
        30.0,
        "High perplexity - model may be uncertain about its outputs",
        60.0,
        "Good coherence and confidence",
    ),
}
DEFAULT_ADVICE = "Model performance is within acceptable ranges"

# --- Fixed values: chat session ----------------------------------------------
CONTEXT_LIMIT = 2048
CONTEXT_WARN_SHARE = 0.7
CONTEXT_MIN_LEFT = 100
REPLY_LENGTH = 512
HISTORY_PAIRS = 5
QUIT_COMMANDS = ("quit", "exit", "q")
CLEAR_COMMAND = "clear"
CONTEXT_COMMAND = "context"
OTHER_COMMANDS = ("config", "save")

# --- Fixed values: adapter directories ---------------------------------------
CONFIG_FILE = "adapter_config.json"
MODEL_FILES = ("adapter_model.safetensors", "adapter_model.bin")
OPTIONAL_FILES = (
    "tokenizer_config.json",
    "tokenizer.json",
    "special_tokens_map.json",
    "README.md",
)
CHECKPOINT_PREFIX = "checkpoint-"

# --- Fixed values: data files ------------------------------------------------
LINE_SUFFIXES = (".jsonl", ".jsonl.gz", ".json", ".json.gz")
CATALOG_SUFFIXES = (".json", ".jsonl")
SPLIT_INFO_FILE = "dataset_infos.json"

# --- Fixed values: training log ----------------------------------------------
# time | level | name:function:line - Step N | key: value, ...
STEP_LINE = (
    r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \| \w+ *\| [^:]*:[^:]*:\d+ - Step (\d+) \| (.*)$"
)
LOG_TIME = "yyyy-MM-dd HH:mm:ss"
