"""Fixed values.

Every value here is part of the result contract: lists, tables, patterns and formats that must be exactly
these for results to agree with existing runs and files. Order is meaning wherever a first match wins.
"""

# --- fixed values: text ---------------------------------------------------------------------------------------

# Unicode whitespace: the characters, the body of a character class in Java, and in RE2 (for SQL engines on RE2).
# Java's property test is several times faster than the spelled-out ranges; it lacks the four separators.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WHITESPACE = r"\x1c-\x1f\p{IsWhite_Space}"
WHITESPACE_RE2 = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

CJK_PUNCTUATION = "，。、；：！？"

PROBE_MIN_CHARS = 3
PROBE_MIN_WORDS = 2
PROBE_MAX_WORDS = 100
PROBE_MIN_ALNUM_RATIO = 0.7
PROBE_MAX_LETTER_RUN = 3

DOMAIN_KEYWORDS = {
    "science": ["science", "research", "experiment", "theory", "hypothesis"],
    "technology": ["technology", "computer", "software", "AI", "machine"],
    "arts": ["art", "music", "painting", "creative", "design"],
    "social": ["society", "culture", "people", "relationship", "community"],
    "philosophy": ["meaning", "existence", "reality", "consciousness", "ethics"],
}

COMMA_WEIGHT = 2
SEMICOLON_WEIGHT = 3

# --- fixed values: model names --------------------------------------------------------------------------------

PROVIDER_PREFIXES = [
    ("openai", ["gpt-3.5", "gpt-4", "gpt-4o", "gpt-4-turbo", "o1-", "o3-",
                "text-davinci", "text-curie", "text-babbage", "text-ada"]),
    ("openrouter", ["openrouter/", "openrouter:", "anthropic/claude-", "deepseek/", "openai/gpt-3", "openai/gpt-4",
                    "google/gemini-", "z-ai/", "x-ai/grok-", "cohere/command", "perplexity/"]),
    ("gemini", ["gemini-", "models/gemini-", "gemini-pro"]),
]
DEFAULT_PROVIDER = "huggingface"
API_PROVIDERS = ["openai", "openrouter", "gemini", "anthropic"]

# family, architecture, organization; the first family contained in the lower-cased name wins
MODEL_FAMILIES = [
    ("bert", "encoder_only", "Google"),
    ("roberta", "encoder_only", "Facebook"),
    ("deberta", "encoder_only", "Microsoft"),
    ("electra", "encoder_only", "Google"),
    ("distilbert", "encoder_only", "Hugging Face"),
    ("gpt", "decoder_only", "OpenAI"),
    ("gpt2", "decoder_only", "OpenAI"),
    ("llama", "decoder_only", "Meta"),
    ("mistral", "decoder_only", "Mistral AI"),
    ("qwen", "decoder_only", "Alibaba"),
    ("gemma", "decoder_only", "Google"),
    ("phi", "decoder_only", "Microsoft"),
    ("falcon", "decoder_only", "Technology Innovation Institute"),
    ("deepseek", "decoder_only", "DeepSeek"),
    ("yi", "decoder_only", "01.AI"),
    ("bloom", "decoder_only", "BigScience"),
    ("pythia", "decoder_only", "EleutherAI"),
    ("t5", "encoder_decoder", "Google"),
    ("flan", "encoder_decoder", "Google"),
    ("bart", "encoder_decoder", "Facebook"),
    ("ul2", "encoder_decoder", "Google"),
]

ENCODER_DECODER_NAMES = ["t5", "flan-t5", "ul2", "flan-ul2", "bart", "pegasus", "mbart", "mt5"]
ENCODER_ONLY_NAMES = ["bert", "roberta", "distilbert", "electra", "deberta", "xlm-roberta"]
DECODER_ONLY_NAMES = [
    "gpt", "llama", "mistral", "falcon", "opt", "bloom", "mpt", "pythia", "qwen", "yi", "gemma", "phi", "deepseek",
    "codellama", "vicuna", "dolly", "stablelm", "open_llama", "tinyllama", "glm", "typhoon", "seed", "deci",
    "ministral", "mixtral",
]
DEFAULT_ARCHITECTURE = "decoder_only"
GENERATIVE_ARCHITECTURES = ["decoder_only", "encoder_decoder"]

CONFIG_DECODER_CLASSES = ["ForCausalLM", "GPTLMHeadModel"]
CONFIG_ENCODER_DECODER_CLASSES = ["ForConditionalGeneration"]
CONFIG_ENCODER_CLASSES = ["ForMaskedLM"]
CONFIG_ENCODER_CLASSES_CATALOG = ["ForMaskedLM", "Model"]
CONFIG_ENCODER_TYPES = ["bert", "roberta", "deberta", "electra", "distilbert"]
CONFIG_ENCODER_DECODER_TYPES = ["t5", "bart", "pegasus"]
CONFIG_DECODER_TYPES = ["gpt2", "llama", "mistral", "qwen2", "gemma"]

CHAT_NAME_PATTERNS = ["chat", "instruct", "instruction", "-it", "alpaca", "vicuna", "wizardlm", "dolly",
                      "assistant", "helper", "conversational"]
CHAT_TEMPLATE_NAME_PATTERNS = ["chat", "instruct", "-it", "alpaca", "vicuna", "wizardlm"]
CHAT_GENERATE_NAME_PATTERNS = ["chat", "instruct", "-it"]
CHAT_INDICATOR_TOKENIZER = "has_chat_template_in_tokenizer_config"
CHAT_INDICATOR_CONFIG = "has_chat_template_in_config"
CHAT_INDICATOR_NAME = "name_pattern_match"

UNSUPPORTED_NAMES = ["janus", "glm-4.1v"]
LARGE_NAMES = ["20b", "24b", "30b", "32b", "34b", "70b", "72b", "13b", "14b", "mixtral", "gpt-neox-20b", "flan-ul2",
               "mistral-small", "qwq", "glm-4-32b"]
LIKELY_LARGE_EXTRA_NAMES = ["yi-34b"]
TRUST_CODE_NAMES = ["openai/gpt-oss", "openai/gpt_oss", "microsoft/phi", "bigcode/", "codellama/", "wizardlm/",
                    "teknium/", "nousresearch/", "garage-baind/", "gpt-oss"]

# pattern, unit in billions; the first pattern that matches the lower-cased name wins
SIZE_PATTERNS = [
    (r"(\d+\.?\d*)\s*b(?:illion)?(?:[^a-z]|$)", "b"),
    (r"(\d+\.?\d*)b[_-]", "b"),
    (r"[_-](\d+\.?\d*)b", "b"),
    (r"(\d+\.?\d*)\s*m(?:illion)?(?:[^a-z]|$)", "m"),
    (r"(\d+\.?\d*)m[_-]", "m"),
    (r"[_-](\d+\.?\d*)m", "m"),
]
# the batch-class rule knows the dash only
BATCH_SIZE_PATTERNS = [
    (r"(\d+\.?\d*)\s*b(?:illion)?(?:[^a-z]|$)", "b"),
    (r"(\d+\.?\d*)b-", "b"),
    (r"-(\d+\.?\d*)b", "b"),
    (r"(\d+\.?\d*)\s*m(?:illion)?(?:[^a-z]|$)", "m"),
    (r"(\d+\.?\d*)m-", "m"),
    (r"-(\d+\.?\d*)m", "m"),
]
CONFIG_COUNT_FIELDS = ["num_parameters", "n_params", "total_params"]
# upper bound in billions (exclusive), category
SIZE_CATEGORIES = [(1, "small"), (7, "medium"), (20, "large"), (50, "very_large")]
LARGEST_SIZE_CATEGORY = "ultra_large"
# lower bound in billions, class, batch size
BATCH_CLASSES = [(60, "very_large", 1), (30, "large", 2)]
DEFAULT_BATCH_CLASS = ("standard", 8)
UNKNOWN_BATCH_CLASS = ("medium", 8)
AUTO_8BIT_BILLIONS = 7.0
MIN_INPUT_TOKENS = 64
DEFAULT_CONTEXT = 1024

# gigabytes at float16; the first key contained in the name wins
MEMORY_GB = [
    ("distilgpt2", 0.5), ("gpt2", 1.0), ("gpt2-medium", 3.0), ("gpt2-large", 6.0), ("opt-350m", 2.0),
    ("opt-1.3b", 5.0), ("opt-6.7b", 25.0), ("gpt-neo-1.3b", 5.0), ("gpt-j-6b", 24.0),
]
DEFAULT_MEMORY_GB = 2.0

CATALOG_TASKS = ["text-generation", "text2text-generation"]
CATALOG_TARGET = 12000

# --- fixed values: datasets -----------------------------------------------------------------------------------

DATASET_ALIASES = {
    "syn": "synthetic", "squad": "squad", "cqa": "commonsense_qa", "hs": "hellaswag", "wg": "winogrande",
    "arc": "arc", "mmlu": "mmlu", "embed": "embedllm", "mix": "mixed", "rand": "rand", "rand_chinese": "rand_chinese",
}
# dataset id: source name, subset, split, text column, sample limit
DATASETS = {
    "embedllm": ("RZ412/EmbedLLM", None, "train", "prompt", None),
    "squad": ("squad", None, "train", "question", 1000),
    "commonsense_qa": ("commonsense_qa", None, "train", "question", 1000),
    "hellaswag": ("hellaswag", None, "train", "ctx", 1000),
    "winogrande": ("winogrande", "winogrande_xl", "train", "sentence", 1000),
    "arc": ("ai2_arc", "ARC-Challenge", "train", "question", 1000),
    "mmlu": ("cais/mmlu", "all", "test", "question", 1000),
    "rand": ("rand", None, "train", "text", 600),
    "rand_chinese": ("rand_chinese", None, "train", "text", 100),
}
TEXT_COLUMN_FALLBACKS = ["prompt", "question", "text"]
STREAM_BATCH = 1000

# --- fixed values: files --------------------------------------------------------------------------------------

MODEL_LIST_STEM = "llm_list"
CATALOG_STEM = "llm_metadata"
CATALOG_MARK = "metadata"
# ending of a list file's stem, ending of its catalog file's stem; the first that fits
LIST_ENDINGS = [("_list", "_metadata"), ("-list", "-metadata"), ("list", "metadata")]
EXTRACTION_METHOD_PREFIX = "text_response_embeddings_"
NORMALIZED_MARK = "_normalized_"
RESPONSES_FILE = "responses.json"
PROBE_CACHE_PREFIX = "dataset_"

SIGNATURE_VALUE_COLUMN = "dna_value"
SIGNATURE_COLUMN_PREFIX = "dna_"
SIGNATURE_FILE_SUFFIX = "_dna"
BATCH_ID_PREFIX = "prompt_"
BATCH_ENDPOINT = "/v1/chat/completions"
BATCH_MAX_REQUESTS = 512
BATCH_MAX_BYTES = 18 * 1024 * 1024

ENTROPY_BINS = 50
ENTROPY_FLOOR = 1e-10
ZERO_TOLERANCE = 1e-8

# --- fixed values: probe templates ----------------------------------------------------------------------------

PROBE_DOMAINS = ["general", "reasoning", "creative", "factual", "conversational"]
PROBE_TEMPLATES = {
    "general": ["What is {}?", "How does {} work?", "Explain the concept of {}.", "Tell me about {}.", "Describe {}."],
    "reasoning": ["If {}, then what would happen?", "What is the relationship between {} and {}?",
                  "Compare {} and {}.", "What are the pros and cons of {}?", "Analyze the following: {}"],
    "creative": ["Write a story about {}.", "Imagine a world where {}.", "Create a poem about {}.",
                 "Design a {} that could {}.", "Invent a new {} for {}."],
    "factual": ["What year did {} happen?", "Who invented {}?", "Where is {} located?",
                "What is the capital of {}?", "How many {} are there?"],
    "conversational": ["Hello, how are you?", "What do you think about {}?", "Can you help me with {}?",
                       "I'm feeling {} today.", "What's your opinion on {}?"],
}
PROBE_ENTITIES = [
    "artificial intelligence", "climate change", "democracy", "education", "technology", "music", "art", "science",
    "history", "philosophy", "economics", "politics", "culture", "nature", "space", "medicine", "literature",
    "mathematics", "psychology", "sociology",
]
FILLER_PROBES = [
    "What is the meaning of life?", "How do machines learn?", "Why is the sky blue?", "What makes humans creative?",
    "How does language work?", "What is consciousness?", "How do we make decisions?",
    "What is the future of technology?", "How do we solve complex problems?", "What is the nature of reality?",
]
# domains that draw on a dataset, dataset
DOMAIN_DATASETS = [
    (["general", "conversational"], "squad"),
    (["reasoning"], "commonsense_qa"),
    (["creative"], "writing_prompts"),
]
FALLBACK_PROBES = {
    "squad": ["What is the capital of France?", "Who invented the telephone?",
              "When was the United Nations founded?", "What is photosynthesis?", "How does gravity work?"],
    "commonsense_qa": ["What happens when you heat water to 100°C?", "Why do birds fly south in winter?",
                       "What is needed to make bread rise?", "How do plants get energy?", "What causes rain?"],
    "writing_prompts": ["Write about a day when everything went wrong.", "Describe a world where colors have sounds.",
                        "Tell a story about finding a mysterious key.", "Imagine meeting your future self.",
                        "Write about a library that never closes."],
}
DEFAULT_FALLBACK_PROBES = ["What is the meaning of life?", "How do machines learn?", "Why is the sky blue?",
                           "What makes humans creative?", "How does language work?"]

STANDARD_PROBES = {
    "general": [
        "What is artificial intelligence?", "How does language work?", "Explain the concept of time.",
        "What makes humans unique?", "How do we learn new things?", "What is the purpose of education?",
        "How does technology affect society?", "What is the meaning of success?",
        "How do we make ethical decisions?", "What is the role of creativity?", "How does communication work?",
        "What is the nature of reality?", "How do we solve problems?", "What is the importance of diversity?",
        "How do we build relationships?", "What is the future of humanity?", "How does culture shape us?",
        "What is the value of knowledge?", "How do we adapt to change?", "What makes life meaningful?",
    ],
    "reasoning": [
        "If all birds can fly, and penguins are birds, can penguins fly?",
        "What is the relationship between cause and effect?", "How do we know what we know?",
        "What makes an argument logical?", "How do we distinguish correlation from causation?",
        "What is the difference between induction and deduction?", "How do we make decisions under uncertainty?",
        "What are the limits of human reasoning?", "How do biases affect our thinking?",
        "What is the role of intuition in problem-solving?", "How do we evaluate evidence?",
        "What makes a good explanation?", "How do we handle contradictory information?",
        "What is the nature of logical paradoxes?", "How do we reason about the future?",
    ],
    "creative": [
        "Write a story about a time-traveling librarian.", "Imagine a world where gravity works backwards.",
        "Create a poem about the color of music.", "Design a machine that runs on dreams.",
        "Invent a new sport for aliens.", "Describe a painting that doesn't exist yet.",
        "Write a conversation between mathematics and art.", "Imagine what thoughts look like.",
        "Create a recipe for happiness.", "Design a city for invisible people.",
        "Write a love letter from one planet to another.", "Invent a language that only uses colors.",
        "Describe the sound of silence.", "Create a dance that tells the story of rain.",
        "Imagine what happens after the last page of a book.",
    ],
    "factual": [
        "What is the capital of France?", "Who invented the telephone?", "When did World War II end?",
        "What is the chemical symbol for gold?", "How many continents are there?", "What is the speed of light?",
        "Who wrote Romeo and Juliet?", "What is the largest planet in our solar system?",
        "When was the internet invented?", "What is the tallest mountain in the world?",
        "Who painted the Mona Lisa?", "What is the smallest unit of matter?",
        "How many bones are in the human body?", "What is the currency of Japan?",
        "When did humans first land on the moon?",
    ],
    "conversational": [
        "Hello, how are you today?", "What's your favorite type of music?", "Can you help me plan a vacation?",
        "I'm feeling stressed about work.", "What do you think about climate change?",
        "Tell me a joke to cheer me up.", "What's the best way to learn a new skill?",
        "I'm having trouble sleeping.", "What's your opinion on social media?", "How do you stay motivated?",
        "What's the most interesting thing you've learned recently?", "I'm trying to eat healthier.",
        "What makes a good friend?", "How do you handle disagreements?",
        "What's your advice for someone starting their career?",
    ],
    "coding": [
        "Write a function to reverse a string.", "How do you implement a binary search?",
        "What is the difference between a list and a tuple in Python?", "Explain object-oriented programming.",
        "How do you handle exceptions in code?", "What is recursion and when would you use it?",
        "Write a function to find the factorial of a number.", "How do you optimize code performance?",
        "What are design patterns in programming?", "Explain the concept of Big O notation.",
        "How do you implement a stack data structure?",
        "What is the difference between synchronous and asynchronous programming?",
        "Write a function to check if a string is a palindrome.", "How do you debug code effectively?",
        "What are the principles of clean code?",
    ],
    "multilingual": [
        "Hello, how are you?", "Hola, ¿cómo estás?", "Bonjour, comment allez-vous?",
        "Guten Tag, wie geht es Ihnen?", "こんにちは、元気ですか？", "你好，你好吗？", "Привет, как дела?",
        "Ciao, come stai?", "안녕하세요, 어떻게 지내세요?", "مرحبا، كيف حالك؟", "Olá, como você está?",
        "Hej, hur mår du?", "Hallo, hoe gaat het?", "Γεια σου, πώς είσαι;", "नमस्ते, आप कैसे हैं?",
    ],
}

# --- fixed values: sentence grammars --------------------------------------------------------------------------
# Names in braces are expanded by choosing one of their forms; names with a leading underscore are word classes.

ENGLISH_GRAMMAR = {
    "S": [
        "{NP} {VP}.", "{NP} {VP} and {NP} {VP}.", "When {NP} {VP}, {NP} {VP}.", "Although {NP} {VP}, {NP} {VP}.",
        "After {NP} {VP}, {NP} {VP}.", "If {NP} {VP}, {NP} will {_VERB_BASE}.", "{NP} {VP} because {NP} {VP}.",
        "{NP} {VP} while {NP} {VP}.", "{NP} {VP}, but {NP} {VP}.", "{NP} {VP} before {NP} {VP}.",
    ],
    "NP": ["the {_NOUN}", "the {_ADJ} {_NOUN}", "a {_NOUN}", "a {_ADJ} {_NOUN}", "the {_ADJ} {_ADJ2} {_NOUN}"],
    "VP": ["{_VERB} {NP}", "{_VERB} {PP}", "{_VERB} {NP} {PP}", "{_VERB} {ADV}", "{_VERB}"],
    "PP": ["near {NP}", "with {NP}", "beside {NP}", "across {NP}", "around {NP}", "behind {NP}", "toward {NP}",
           "inside {NP}", "above {NP}", "under {NP}"],
    "ADV": ["quickly", "slowly", "carefully", "quietly", "suddenly", "gently", "eagerly", "steadily", "calmly",
            "gracefully"],
}
ENGLISH_WORD_CLASSES = {"_NOUN": "nouns", "_VERB": "verbs", "_VERB_BASE": "verbs", "_ADJ": "adjectives",
                        "_ADJ2": "adjectives"}
ENGLISH_WORDS_PER_SAMPLE = 100
ENGLISH_SHORTEST_SENTENCE = 3

CHINESE_GRAMMAR = {
    "S": ["{CLAUSE}。", "{CLAUSE}，{CLAUSE}。", "{JUDGMENT}。", "{CONDITIONAL}。", "{CONCESSIVE}。", "{SEQUENCE}。",
          "{PARALLEL}。"],
    "CLAUSE": ["{SUBJ_OPT}{VP}", "{SUBJ_OPT}{VP}于{_PLACE}", "{SUBJ_OPT}{VP}而{VP}", "以{_ABSTRACT_NOUN}为{NP}"],
    "CLAUSE_SHORT": ["{SUBJ_OPT}{VP}", "{SUBJ_OPT}{VP}于{_PLACE}", "以{_ABSTRACT_NOUN}为{NP}"],
    "JUDGMENT": ["{NP}者，{PRED}也", "{_HUMAN_NOUN}者，{VP}者也", "{_ABSTRACT_NOUN}者，{_ABSTRACT_NOUN}之本也"],
    "PRED": ["{_ADJ}", "{_ABSTRACT_NOUN}之{_ADJ}者", "{_THING_NOUN}之{_ADJ}者"],
    "CONDITIONAL": ["若{CLAUSE_SHORT}，则{CLAUSE_SHORT}", "苟{CLAUSE_SHORT}，则{CLAUSE_SHORT}"],
    "CONCESSIVE": ["虽{CLAUSE_SHORT}，犹{CLAUSE_SHORT}", "虽{CLAUSE_SHORT}，而{CLAUSE_SHORT}"],
    "SEQUENCE": ["既{CLAUSE_SHORT}，乃{CLAUSE_SHORT}"],
    "PARALLEL": ["{FOURCHAR}，{FOURCHAR}", "{PAIR_VP}，{PAIR_VP}", "或{VP}，或{VP}"],
    "FOURCHAR": ["{_MONO_VERB}{_MONO_NOUN}{_MONO_VERB}{_MONO_NOUN}", "{_MONO_ADJ}{_MONO_NOUN}{_MONO_ADJ}{_MONO_NOUN}"],
    "PAIR_VP": ["{_VERB_MORAL}{_ABSTRACT_NOUN}而{_VERB_MORAL}{_ABSTRACT_NOUN}",
                "{_VERB_MENTAL}{_THING_NOUN}而{_VERB_MENTAL}{_ABSTRACT_NOUN}"],
    "VP": ["{_VERB_MORAL}{OBJ}", "{_VERB_MENTAL}{_ABSTRACT_NOUN}", "{_VERB_GOVERN}{_STATE_NOUN}",
           "{_VERB_MOTION}{_PLACE}", "{_VERB_CHANGE}", "不{_VERB_MORAL}{OBJ}", "未{_VERB_MENTAL}{_ABSTRACT_NOUN}"],
    "OBJ": ["{_ABSTRACT_NOUN}", "{_THING_NOUN}", "{_STATE_NOUN}"],
    "NP": ["{_HUMAN_NOUN}", "{_ABSTRACT_NOUN}", "{_THING_NOUN}", "{_STATE_NOUN}", "{_MONO_NOUN}之{_MONO_NOUN}",
           "{_ADJ}{_MONO_NOUN}", "{_ADJ}之{_MONO_NOUN}"],
    "SUBJ_OPT": ["", "", "{_HUMAN_NOUN}", "{_THING_NOUN}", "{_STATE_NOUN}"],
}
CHINESE_WORD_CLASSES = {
    "_HUMAN_NOUN": "human_nouns", "_ABSTRACT_NOUN": "abstract_nouns", "_THING_NOUN": "thing_nouns",
    "_STATE_NOUN": "state_nouns", "_PLACE": "places", "_VERB_MORAL": "verbs_moral", "_VERB_MENTAL": "verbs_mental",
    "_VERB_GOVERN": "verbs_govern", "_VERB_MOTION": "verbs_motion", "_VERB_CHANGE": "verbs_change",
    "_ADJ": "adjectives", "_MONO_NOUN": "mono_nouns", "_MONO_VERB": "mono_verbs", "_MONO_ADJ": "mono_adjectives",
    "_DUAL": "dual_terms",
}
CHINESE_CHARS_PER_SAMPLE = 100
CHINESE_SHORTEST_SENTENCE = 1
# --- end of fixed values --------------------------------------------------------------------------------------
