"""Word lists, patterns, weights and limits that results depend on."""

# Words that a strict keyword query leaves out.
STOPWORDS = (
    "a an the is was are were be been am do did does have has had will would shall should can could may might must "
    "i me my we our you your he she it they his her its them their in on at to for of with by from as "
    "and or but not no if so that this what which who how when where why"
).split()

# Phrases that are not worth storing.
BOILERPLATE = (
    "hello", "hi there", "hey", "thanks", "thank you", "ok", "okay", "got it", "sounds good", "yes", "no", "sure", "bye", "goodbye",
    "see you", "good morning", "good afternoon", "good evening", "how are you", "i'm good", "i am good", "what's up", "not much",
    "nm", "lol", "haha", "lmao",
)

# Phrases of prompt injection and their weights.
INJECTION = (
    ("ignore previous", 2.0),
    ("ignore all instructions", 3.0),
    ("disregard the above", 2.0),
    ("disregard all previous", 3.0),
    ("forget everything", 2.0),
    ("new instructions:", 2.5),
    ("system prompt:", 2.5),
    ("you are now", 1.5),
    ("[SYSTEM]", 2.0),
    ("<|im_start|>", 3.0),
    ("### Instruction:", 2.0),
    ("<|endoftext|>", 3.0),
    ("<s>[INST]", 3.0),
    ("send all data to", 3.0),
    ("upload everything to", 3.0),
    ("POST all memories to", 3.0),
    ("exfiltrate", 2.0),
    ("IMPORTANT: do not show", 2.5),
    ("hidden instruction", 2.0),
)
BIDI_WEIGHT, SUSPICIOUS, BLOCKED = 3.0, 3.0, 7.0
#: Controls that turn the direction of writing.
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"

# What a query for credentials mentions.
CREDENTIAL_WORDS = (
    "api key", "api_key", "apikey", "password", "passwd", "pwd", "token", "auth_token", "bearer", "secret", "credential",
    "private key", "ssh key", ".env", "environment variable", "aws_access", "AKIA", "connection string",
)

# Shapes of secrets, in the syntax that Java's and RE2's expressions share.
SECRETS = {
    "github": r"gh[phosr]_[A-Za-z0-9]{36}",
    "openai": r"sk-[A-Za-z0-9]{32}",
    "aws": r"(AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "api_key": r"[Aa][Pp][Ii][_-]?[Kk][Ee][Yy] ?[:=] ?[A-Za-z0-9]{20}",
    "password": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Pp][Ww][Dd]) ?[:=] ?[^ \t\r\n]{8}",
}
ENTROPY_LENGTH, ENTROPY_BITS = 32, 4.5

MONTHS = "january february march april may june july august september october november december".split()

# Limits and defaults of the query surface.
TOP_K, MOST_K = 10, 50
RANKER_LIMIT, ENTITY_SEEDS, RRF_K = 100, 5, 60
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6
DAY_MS = 86_400_000
END_OF_DAY_MS = DAY_MS - 1
MOST_BYTES = 65536
HALF_LIFE_DAYS, PRUNE_AGE_DAYS, PRUNE_BELOW, PRUNE_ROWS = 90.0, 90, 0.1, 200
CLUSTER_DISTANCE = 0.3
CHUNK_BYTES, PIECE_BYTES, TURN_REACH = 800, 4096, 200
