"""Values fixed by the published result files and report layout."""

# Cell texts read as missing in an item CSV (the usual pandas set).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Column names of an item CSV.
TEXT_COLUMN = "Requirement Statement"
LABEL_COLUMN = "Label"

# Class name that stands for a missing prediction.
UNKNOWN = "UNKNOWN"

# Separators of experiment, run and prompt ids.
ID_SEPARATOR = "__"
RUN_MARK = "__run"
PROMPT_KEY_SEPARATOR = "|"

# The three axes of the condition grid, in report order.
SHOT_TYPES = ("zero_shot", "one_shot", "few_shot")
LENGTHS = ("short", "medium", "long")
CONTEXT_LEVELS = ("no_context", "some_context", "full_context")

# Report order of models and datasets.
MODEL_ORDER = ("llama2", "mistral", "gpt4")
DATASET_ORDER = ("lms", "smart")

# Display names used in the report tables.
MODEL_NAMES = {"llama2": "LLaMA-2", "mistral": "Mistral", "gpt4": "GPT-4"}
SHOT_NAMES = {"zero_shot": "Zero-shot", "one_shot": "One-shot", "few_shot": "Few-shot"}
LENGTH_NAMES = {"short": "Short", "medium": "Medium", "long": "Long"}
CONTEXT_NAMES = {
    "no_context": "No Context",
    "some_context": "Some Context",
    "full_context": "Full Context",
}
DATASET_NAMES = {"lms": "Library Management", "smart": "Smart Home"}

# Experiment defaults.
DEFAULT_SEED = 42
DEFAULT_RUNS = 5
DEFAULT_ONE_SHOT = 1
DEFAULT_FEW_SHOT = 3
DEFAULT_POOL_PER_LABEL = 2

# Answer clean-up and fuzzy matching.
ANSWER_EDGE_CHARS = "\"'`.,;:!?\n\r\t"
FUZZY_THRESHOLD = 0.80
FUZZY_CHARS = 30

# Request policy.
MAX_ATTEMPTS = 5
BACKOFF_BASE = 2.0
BATCH_SIZE = 8

# Instruction formats of two public chat models.
INSTRUCTION_FORMATS = {
    "mistral": ("<s>[INST] ", " [/INST]"),
    "llama2": ("<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n", " [/INST]"),
}
INSTRUCTION_END = "[/INST]"
