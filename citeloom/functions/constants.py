"""Fixed values the results depend on: word lists, price tables, patterns, thresholds."""

# Search stop words.
SEARCH_STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had "
    "do does did will would could should may might must shall can need this that these those it "
    "its we our they their them he she him her his hers which who whom whose what where when why "
    "how not no nor yet so than too very just also only more most some any all each every both few "
    "several other such into over"
).split()

# Embedding stop words.
EMBED_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may "
    "might must can could am not no nor so if or and but for to of in on at by with from as into "
    "through during before after above below between out off over under again further then once "
    "here there when where why how all both each few more most other some such than too very just "
    "only own same that this these those it its he she they we you i me my our your his her their "
    "what which who whom"
).split()

# Python keywords kept apart by the code tokenizer.
PYTHON_KEYWORDS = (
    "def class return if else elif for while try except finally with import from as pass break "
    "continue and or not in is lambda yield async await"
).split()
CODE_PUNCTUATION = "(){}[].,;:+=*/<>!&|-"

# Provider prices in dollars per million tokens, (input, output).
PROVIDER_PRICES = {
    "anthropic": (15.0, 75.0),
    "openai": (5.0, 15.0),
    "google": (1.25, 5.0),
}

# Credential prefixes in matching order.
KEY_PREFIXES = [
    ("sk-ant", "anthropic"),
    ("sk-or-", "openrouter"),
    ("sk-", "openai"),
    ("ghp_", "github"),
    ("github_pat_", "github"),
    ("ghu_", "github_copilot"),
    ("ya29.", "google"),
    ("1//", "google"),
    ("gsk_", "groq"),
    ("co-", "cohere"),
]

# Secret names redacted from key=value text.
SECRET_ASSIGNMENT = (
    r"(?i)\b([A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASS|AUTH|COOKIE|SESSION)[A-Z0-9_]*)\s*=\s*([^\s]+)"
)

# Prompt text that blocks a text outright, and text that is only redacted.
DANGEROUS_PROMPT = [
    r"api[_\s]?key",
    r"password\s*=",
    r"secret\s*token",
    r"eval\s*\(",
    r"exec\s*\(",
    r"__import__\s*\(",
    r"subprocess\s*\.",
]
INJECTION_PROMPT = [
    r"ignore\s+(previous|all)\s+(instructions?|commands?)",
    r"disregard\s+(previous|all)\s+(instructions?|commands?)",
    r"you\s+are\s+(now\s+a)?[\s\w]*assistant\s+(that\s+)?reveal",
    r"forget\s+(everything|all)\s+above",
    r"new\s+instructions?:\s*",
    r"system\s+(prompt|instruction)",
    r"#\s*instructions?",
    r"<\|system\|>",
    r"\{\{.*?system.*?\}\}",
]
BLOCKED_NOTICE = "[content blocked: potential security risk]"

# Section title rules in order.
SECTION_RULES = [
    ("abstract", r"(?i)^abstract$"),
    ("introduction", r"(?i)^(?:\d+\.?\s+)?introduction$"),
    ("related", r"(?i)related work|background|prior work"),
    ("method", r"(?i)method|approach|model|architecture|algorithm"),
    ("experiments", r"(?i)experiment|evaluation|results|benchmark"),
    ("conclusion", r"(?i)conclusion|discussion|future work"),
]

# Equation types and their trigger words in order.
EQUATION_RULES = [
    ("loss", ["loss", "objective", "cross entropy", "regularization"]),
    ("metric", ["accuracy", "bleu", "f1", "precision", "recall", "perplexity", "metric"]),
    ("model", ["embedding", "attention", "transformer", "decoder", "encoder", "model"]),
    ("notation", ["notation", "where", "let", "denote"]),
]

# Fixed values: (domain, subdomain, pattern) in table order.
DOMAIN_RULES = [
    ("nlp", "language-modeling", "language model|causal lm|masked lm|perplexity|tokeniz"),
    ("nlp", "machine-translation", "translation|bleu|encoder-decoder"),
    ("nlp", "question-answering", "question answering|qa benchmark|squad"),
    ("nlp", "general", "transformer|bert|gpt|attention|tokeniz|embedding"),
    ("cv", "object-detection", "object detection|yolo|faster r-cnn|mAP"),
    ("cv", "segmentation", "segmentation|mask r-cnn|iou"),
    ("cv", "classification", "image classification|resnet|vit|imagenet"),
    ("cv", "general", "convolution|resnet|yolo|detection|segmentation|vision transformer|vit"),
    ("rl", "policy-gradient", "policy gradient|ppo|actor-critic"),
    ("rl", "value-learning", "q-learning|dqn|td error"),
    ("rl", "general", "reward|policy|environment|agent|markov|reinforcement learning"),
    ("systems", "distributed-systems", "distributed|consensus|replication|fault tolerance"),
    ("systems", "memory-systems", "cache|memory allocator|paging|tlb"),
    ("systems", "general", "kernel|mutex|scheduler|memory|cache|network throughput|latency"),
    ("theory", "optimization-theory", "convex|convergence|regret"),
    ("theory", "general", "theorem|proof|lemma|corollary|bound|complexity"),
    ("biology", "protein-modeling", "protein|amino acid|folding"),
    ("biology", "genomics", "genom|rna|dna|sequence alignment|cell"),
    ("biology", "general", "protein|sequence|genomics|rna|dna|cell|biopython|rdkit"),
    ("multimodal", "vision-language", "vision-language|image-text|captioning|clip"),
    ("multimodal", "audio-visual", "audio-visual|speech-image|multimodal fusion"),
    ("multimodal", "general", "vision-language|clip|image-text|audio-visual|multimodal"),
]

# Paper categories and their keywords in table order.
CATEGORY_KEYWORDS = [
    ("normalization", ["rmsnorm", "normalization", "layer norm", "layernorm", "norm"]),
    ("attention", ["attention", "query", "key", "value", "flash"]),
    ("activation", ["activation", "gelu", "swish", "silu", "glu", "feedforward", "mlp"]),
    ("position_encoding", ["position", "positional", "rope", "rotary", "alibi", "embedding"]),
    ("optimizer", ["optimizer", "adam", "adamw", "schedule", "learning rate", "warmup"]),
    ("architecture", ["expert", "moe", "mixture", "transformer", "block", "router"]),
]

# Compound requests, (trigger, primary action, complexity, token cost).
COMPOUND_INTENTS = [
    ("analyze and suggest", "analyze", "moderate", 5000),
    ("analyze then suggest", "analyze", "moderate", 5000),
    ("suggest and integrate", "suggest", "complex", 28000),
    ("suggest then integrate", "suggest", "complex", 28000),
    ("find and apply", "suggest", "complex", 28000),
    ("full pipeline", "analyze", "complex", 28000),
    ("end to end", "analyze", "complex", 28000),
    ("everything", "analyze", "complex", 28000),
]

# Single-action requests, (action, keywords, complexity, token cost), in order.
ACTION_INTENTS = [
    ("help", ["help", "commands", "what can you do", "?"], "trivial", 100),
    ("status", ["status", "context", "session", "what do you know"], "trivial", 100),
    ("greet", ["hello", "hi", "hey", "start", "good morning", "good evening"], "trivial", 100),
    ("analyze", ["analyze", "analyse", "examine", "look at", "scan"], "simple", 2000),
    ("search", ["search", "find papers", "look for", "research"], "simple", 3000),
    ("suggest", ["suggest", "recommend", "what can", "improvements", "improve"], "simple", 3000),
    ("specs", ["specs", "specifications", "list specs", "available"], "trivial", 500),
    ("validate", ["validate", "test", "run tests", "verify", "check"], "simple", 5000),
    ("security", ["security", "scan vulnerabilities", "audit security"], "simple", 3000),
    ("map", ["map spec", "map to code", "where to apply"], "moderate", 8000),
    ("generate", ["generate patch", "generate code", "create patch"], "moderate", 10000),
    ("integrate", ["integrate", "apply", "implement", "add", "install"], "complex", 25000),
    ("rollback", ["rollback", "revert", "undo"], "simple", 2000),
    ("run_command", ["run ", "execute ", "shell ", "bash ", "!"], "simple", 500),
    ("read_file", ["read file", "show file", "cat ", "open file", "view file"], "trivial", 200),
    ("write_file", ["write file", "save file", "create file", "write to"], "simple", 300),
    ("search_code", ["grep ", "find in code", "search code", "search files"], "simple", 400),
    ("list_files", ["list files", "ls ", "dir ", "list directory", "show files"], "trivial", 100),
    ("git", ["git status", "git log", "git diff", "git branch"], "trivial", 200),
    ("analyze_code", ["lint", "ruff", "check code quality", "code quality"], "simple", 500),
    ("terminal", ["terminal", "shell", "interactive", "console", "!ls", "!cd", "!pwd", "!echo"], "trivial", 100),
    ("run_code", ["run code", "execute code", "run file", "python ", "node ", "python3 "], "simple", 800),
    ("run_tests", ["test", "pytest", "run tests", "run test", "tests", "check test"], "simple", 1000),
    ("fix_and_test", ["fix tests", "fix failing", "auto-fix", "fix and test"], "moderate", 8000),
    ("intelligent_run", ["do it", "fix it", "run it", "execute", "build", "make"], "moderate", 1500),
]
SPEC_NAMES = ["rmsnorm", "swiglu", "flashattention", "rope", "gqa", "mixture", "layernorm", "gelu", "silu", "mqa"]

# Metric name synonyms, metric name tokens, lower-is-better names.
METRIC_SYNONYMS = {
    "acc": "accuracy",
    "top1": "top_1_accuracy",
    "top_1": "top_1_accuracy",
    "top5": "top_5_accuracy",
    "top_5": "top_5_accuracy",
    "f1_score": "f1",
    "f1score": "f1",
    "rouge_l": "rouge_l",
    "bleu_score": "bleu",
    "eval_accuracy": "accuracy",
    "test_accuracy": "accuracy",
    "validation_accuracy": "accuracy",
}
RAW_VALUE_METRICS = ["loss", "error", "perplexity", "latency", "time"]
LOWER_IS_BETTER = (
    "loss train_loss val_loss test_loss perplexity ppl error error_rate mse mae rmse latency "
    "latency_ms memory_mb memory_gb flops cer wer"
).split()
METRIC_CLAIM = r"(?i)([a-z][a-z0-9_\-\s@]{1,40}?)\s*(?:[:=]|is)\s*([-+]?\d*\.?\d+)\s*(%?)"

# Impact tables per spec.
SPEEDUP_BY_SPEC = {"rmsnorm": 0.07, "swiglu": 0.1, "flashattention": 0.25, "rope": 0.05}
MEMORY_BY_SPEC = {"rmsnorm": 0.02, "swiglu": 0.05, "flashattention": 0.3, "rope": 0.01}
CATEGORY_PRIORITY = {"normalization": 1, "activation": 2, "attention": 3, "position_encoding": 4}

# Scan rules, (rule, pattern, severity, message).
SECURITY_RULES = [
    ("eval", r"eval\s*\(", "error", "Use of eval()"),
    ("exec", r"exec\s*\(", "error", "Use of exec()"),
    ("dynamic_import", r"__import__\s*\(", "error", "Dynamic import"),
    ("shell_call", r"subprocess\.call\s*\(\s*\[", "error", "Shell command execution"),
    ("os_system", r"os\.system\s*\(", "error", "os.system call"),
    ("unpickle", r"pickle\.load\s*\(", "error", "Unpickling untrusted data"),
    ("yaml_load", r"yaml\.load\s*\(", "error", "YAML deserialization"),
    ("rmtree", r"shutil\.rmtree\s*\(", "error", "Recursive directory deletion"),
    ("os_remove", r"os\.remove\s*\(", "error", "File deletion"),
    ("ctypes", r"ctypes\.", "error", "C-level memory access via ctypes"),
]
ANTIPATTERN_RULES = [
    ("range_len", r"for\s+\w+\s+in\s+range\(len\(", "warning", "Consider using enumerate() instead of range(len())"),
    ("bool_compare", r"==\s*True|==\s*False", "warning", "Use 'if x:' or 'if not x:' instead of '== True' or '== False'"),
    ("bare_except", r"except\s*:", "warning", "Bare except clause - specify exception type"),
    ("global_use", r"global\s+\w+", "warning", "Use of 'global' - consider class attributes or dependency injection"),
    ("eval_exec", r"eval\(|exec\(", "error", "Use of eval() or exec() - potential security risk"),
]
DESTRUCTIVE_RULES = [
    r"rm\s+-rf\s+/",
    r"dd\s+if=.*of=/dev/sd[^ ]",
    r"curl\s+[^|]*\|\s*bash",
    r"wget\s+[^|]*\|\s*bash",
    r":\(\)\{.*\|\:\)",
    r"os\.system\s*\(",
    r"subprocess\.(call|run|Popen|check_output|check_call)\s*\(",
    r"socket\.",
    r"urllib\.|requests\.",
    r"open\s*\(['\"]/(?:etc|proc|sys|dev|run)/",
    r"os\.remove\s*\(",
    r"os\.unlink\s*\(",
    r"os\.rmdir\s*\(",
    r"shutil\.rmtree\s*\(",
    r"pathlib\.Path\.unlink\s*\(",
    r"pathlib\.Path\.rmdir\s*\(",
    r"pathlib\.Path\s*\(\s*['\"]/",
    r"os\.(?:path|walk|listdir|scandir|remove|rmdir|mkdir|rename|replace)",
    r"shutil\.(?:rmtree|copy|move|copy2)",
    r"open\s*\(\s*['\"]/(?:etc|proc|sys|dev|run|root|home|tmp)/",
    r"os\.environ",
    r"os\.popen\s*\(",
    r"tempfile\.mkdtemp\s*\(",
    r"tempfile\.mkstemp\s*\(",
    r"commands\.(?:getstatusoutput|getoutput)",
    r"threading\.(?:Thread|Timer|Lock|RLock|Condition|Semaphore|Event|Barrier)",
    r"multiprocessing\.(?:Process|Pool|Queue|Pipe|Manager|Value|Array)",
    r"concurrent\.futures\.(?:ThreadPoolExecutor|ProcessPoolExecutor)",
    r"asyncio\.(?:run|create_task|gather|wait|as_completed)",
    r"urllib\.(?:request|parse|response)",
    r"requests\.(?:get|post|put|delete|patch|head|options|request)",
    r"http\.client",
    r"ftplib\.",
    r"telnetlib\.",
    r"smtplib\.",
    r"poplib\.",
    r"imaplib\.",
    r"nntplib\.",
]
ESCAPE_RULES = [
    r"__import__\s*\(",
    r"importlib\.",
    r"sys\.modules",
    r"getattr\s*\(\s*builtins",
    r"__class__|__mro__|__subclasses__|__globals__|__builtins__",
    r"compile\s*\(",
    r"exec\s*\(",
    r"eval\s*\(",
    r"setattr\s*\(",
    r"del\s+os\b|del\s+sys\b|del\s+builtins\b",
    r"__import__\s*\(\s*['\"]os['\"]",
    r"__import__\s*\(\s*['\"]subprocess['\"]",
    r"__import__\s*\(\s*['\"]sys['\"]",
    r"__import__\s*\(\s*['\"]builtins['\"]",
    r"getattr\s*\(\s*__import__",
    r"__builtins__\s*\[",
    r"globals\s*\(\s*\)\s*\[",
    r"locals\s*\(\s*\)\s*\[",
    r"vars\s*\(\s*\)\s*\[",
    r"exec\s*\(\s*compile",
    r"eval\s*\(\s*compile",
    r"ast\.parse\s*\(",
    r"code\.compile_command",
    r"sys\.modules\s*\[",
    r"importlib\.import_module",
    r"importlib\.reload",
    r"pkgutil\.",
    r"runpy\.",
    r"__import__\s*\(\s*['\"]importlib['\"]",
    r"__import__\s*\(\s*['\"]pkgutil['\"]",
    r"__import__\s*\(\s*['\"]runpy['\"]",
    r"pty\.",
    r"ctypes\.",
    r"fcntl\.",
    r"resource\.",
]

# Known import roots.
KNOWN_MODULES = (
    "os sys re json datetime collections itertools functools operator pathlib typing abc copy pickle "
    "shutil tempfile argparse logging traceback torch tensorflow numpy pandas sklearn transformers "
    "flax jax einops tqdm requests fastapi pydantic pytest scipy"
).split()

# Name parts that tag a code element.
NAME_PATTERNS = [
    ("normalization", ["norm", "normalize", "batch", "layer"]),
    ("attention", ["attention", "attn", "self_attn"]),
    ("activation", ["mlp", "feedforward", "ffn", "dense", "relu", "gelu"]),
    ("async", ["async"]),
    ("caching", ["cache", "memo", "store"]),
]

# Framework by import prefix; the second list also matches "prefix/...".
DOTTED_FRAMEWORKS = "django flask fastapi torch tensorflow transformers numpy pandas".split()
PATH_FRAMEWORKS = [("express", "express"), ("react", "react"), ("vue", "vue"), ("nextjs", "next")]

# Paths a source scan skips.
IGNORED_DIRS = (
    ".git __pycache__ node_modules .venv venv dist build .next target .idea .vscode vendor packages "
    ".cache coverage .pytest_cache .mypy_cache .ruff_cache htmlcov .tox"
).split()
IGNORED_PARTS = ".min.js .bundle.js generated .pyc .pyo .class .o .so .dll".split()
ENTRY_FILES = (
    "main.py app.py server.py index.py run.py serve.py cli.py __main__.py index.js main.js app.js "
    "server.js index.ts main.ts app.ts server.ts main.go main.rs lib.rs Main.java App.java"
).split()
TEST_FILE = (
    r"(^|/)(test_[^/]*\.py|[^/]*_test\.(py|go|rs)|[^/]*\.(test|spec)\.(js|ts)|[^/]*Test\.java)$"
    r"|^(tests|test|__tests__|spec)/"
)

# Language by file extension.
LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "csharp": [".cs"],
    "html": [".html", ".htm"],
    "css": [".css", ".scss", ".sass", ".less"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "markdown": [".md"],
    "sql": [".sql"],
    "shell": [".sh", ".bash", ".zsh"],
}

# Language by content; two hits decide, in table order.
LANGUAGE_MARKERS = [
    ("python", ["import ", "from ", "def ", "class ", "if __name__"]),
    ("javascript", ["const ", "let ", "var ", "function ", "=>", "require("]),
    ("typescript", ["interface ", "type ", ": string", ": number", "export "]),
    ("go", ["package ", "func ", "import (", "go "]),
    ("rust", ["fn ", "let mut", "impl ", "use ", "pub fn"]),
    ("java", ["public class", "private ", "import java.", "void "]),
]

# Code-name aliases of the fuzzy matcher.
PATTERN_ALIASES = {
    "layernorm": ["LayerNorm", "layer_norm", "nn.LayerNorm"],
    "nn.layernorm": ["LayerNorm", "layer_norm", "nn.LayerNorm"],
    "nn.gelu": ["GELU", "gelu", "nn.GELU"],
    "gelu": ["GELU", "gelu", "nn.GELU"],
    "self.ln_1": ["ln_1", "self.ln_1", "layer_norm_1", "norm1"],
    "self.ln_2": ["ln_2", "self.ln_2", "layer_norm_2", "norm2"],
    "self.c_attn": ["c_attn", "self.c_attn", "qkv_proj"],
    "self.q_proj": ["q_proj", "self.q_proj", "query_proj"],
    "self.k_proj": ["k_proj", "self.k_proj", "key_proj"],
    "self.wpe": ["wpe", "position_embedding", "pos_embed"],
    "nn.embedding": ["nn.Embedding", "Embedding"],
    "nn.dropout": ["nn.Dropout", "Dropout"],
    "self.drop": ["self.drop", "dropout", "self.attn_dropout", "self.resid_dropout"],
    "self.flash": ["flash", "flash_attn", "flash_attention"],
    "self.gelu = nn.gelu()": ["GELU", "gelu", "nn.GELU"],
    "self.mlp": ["mlp", "self.mlp", "feedforward", "ffn"],
}

# Code keyword to spec names, in table order.
KEYWORD_SPECS = [
    ("norm", ["rmsnorm", "preln_transformer", "qknorm"]),
    ("normalization", ["rmsnorm", "preln_transformer", "qknorm"]),
    ("layer", ["layernorm", "rmsnorm", "preln_transformer"]),
    ("layernorm", ["layernorm", "rmsnorm", "preln_transformer", "qknorm"]),
    ("batchnorm", ["rmsnorm"]),
    ("rms", ["rmsnorm"]),
    ("attention", ["flashattention", "flashattention2", "grouped_query_attention", "rope", "qknorm"]),
    ("self_attention", ["flashattention", "flashattention2", "grouped_query_attention"]),
    ("causalselfattention", ["flashattention", "flashattention2", "grouped_query_attention"]),
    ("multihead", ["grouped_query_attention"]),
    ("flash", ["flashattention", "flashattention2"]),
    ("kv_cache", ["grouped_query_attention"]),
    ("lora", ["lora"]),
    ("adapter", ["lora"]),
    ("linear", ["lora"]),
    ("mlp", ["gelu", "swiglu", "geglu", "mistral"]),
    ("feedforward", ["gelu", "swiglu", "geglu", "mistral"]),
    ("gelu", ["gelu", "swiglu", "geglu"]),
    ("relu", ["swiglu", "geglu"]),
    ("activation", ["gelu", "swiglu", "geglu"]),
    ("ffn", ["gelu", "swiglu", "geglu", "mistral"]),
    ("position", ["rope", "alibi"]),
    ("positional", ["rope", "alibi"]),
    ("embedding", ["rope", "alibi"]),
    ("wpe", ["rope", "alibi"]),
    ("sinusoidal", ["rope", "alibi"]),
    ("optimizer", ["weight_decay_fused", "lion"]),
    ("adam", ["weight_decay_fused", "lion"]),
    ("adamw", ["lion"]),
    ("sgd", ["weight_decay_fused", "cosine_warmup"]),
    ("weight_decay", ["weight_decay_fused"]),
    ("learning_rate", ["cosine_warmup"]),
    ("lr_schedule", ["cosine_warmup"]),
    ("scheduler", ["cosine_warmup"]),
    ("expert", ["mistral"]),
    ("moe", ["mistral"]),
    ("mixture", ["mistral"]),
    ("router", ["mistral"]),
    ("dropout", ["dropout_variants"]),
    ("droppath", ["dropout_variants"]),
    ("dropblock", ["dropout_variants"]),
    ("regulariz", ["dropout_variants"]),
    ("transformer", ["preln_transformer", "flashattention", "swiglu", "rope"]),
    ("block", ["preln_transformer", "dropout_variants"]),
    ("residual", ["preln_transformer", "dropout_variants"]),
]

# Ranks of result states, thresholds of gates and reports.
STATUS_RANK = {
    "matched": 3,
    "partial": 2,
    "missing_candidate": 1,
    "generation_failed": 1,
    "unsupported_spec": 0,
    "mismatch": 0,
}
GATE_MIN_TARGETS = 1
GATE_MIN_CONFIDENCE = 70.0
GATE_MIN_SPEEDUP = 0.95
GATE_MAX_LOSS_CHANGE = 5.0
ACCEPT_PATCH_RATE, ACCEPT_TEST_RATE, ACCEPT_REVIEW_RATE = 0.9, 0.8, 0.7
TRUSTED_REPRODUCIBILITY = 0.75
MIN_TRACEABILITY = 0.50

# Histogram bounds in seconds (the last bucket is +Inf).
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# Hunk decisions.
ACCEPT_WORDS = "accepted accept approve approved allow yes y 1".split()
REJECT_WORDS = "rejected reject denied deny no n 0".split()
REGENERATE_WORDS = "regenerate regen retry".split()

# Equation delimiters, math symbols and words that hint at a pseudocode's language.
EQUATION_DELIMITERS = [
    r"(?s)\$\$(.+?)\$\$", r"(?s)\$(.+?)\$", r"(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}", r"(?s)\\begin\{align\*?\}(.*?)\\end\{align\*?\}",
    r"(?s)\\begin\{gather\*?\}(.*?)\\end\{gather\*?\}", r"(?s)\\\[(.*?)\\\]", r"(?s)\\\((.*?)\\\)",
]
MATH_SYMBOLS = r"[=_^{}\[\]\\/*+\-<>|≈∑∏]"
PYTHON_HINTS = ["for ", "while ", "if ", "return", "def ", "range("]
C_HINTS = ["{", "}", "->", "++", "--", "printf"]

# Where a failure log names a module.
FAILURE_PATTERNS = [
    r"(?:FAILED|ERROR)\s+(tests/[a-zA-Z0-9_./-]+)\.py",
    r"(tests/[a-zA-Z0-9_./-]+)\.py::",
    r"(src/[a-zA-Z0-9_./-]+)\.py",
    r"(?:FAILED|ERROR)\s+tests/test_([a-zA-Z0-9_]+)\.py",
    r"tests/test_([a-zA-Z0-9_]+)\.py::",
]
