"""Lexicons as data. Every operator takes a lexicon as a parameter; these are
the defaults.

FIXED VALUES: the production term lists below must equal the reference's lists
for scores to match; they are kept verbatim, in their declared order (order
matters: ties in best-domain go to the earlier domain).
"""

# ---- FIXED VALUES: production domain lexicon (declared order) ----
DOMAINS: dict[str, list[str]] = {
    "distributed": [
        "distributed", "consensus", "raft", "paxos", "quorum", "replicat*",
        "shard*", "partition tolerance", "eventual consistency",
        "linearizab*", "split brain", "leader election", "gossip", "crdt",
        "idempoten*", "exactly-once", "at-least-once", "backpressure",
        "kubernetes", "k8s", "etcd", "service mesh", "istio", "envoy",
        "microservice*", "rpc", "grpc", "load balanc*", "failover",
    ],
    "storage": [
        "database", "postgres", "mysql", "sqlite", "rocksdb", "lsm tree",
        "b-tree", "btree", "write-ahead", "mvcc", "vacuum", "wal",
        "index scan", "query planner", "columnar", "parquet", "iceberg",
        "object storage", "blob store", "compaction", "durability",
        "fsync", "transaction*", "isolation level", "deadlock", "migration*",
        "connection pool", "query plan", "full table scan", "backup*",
    ],
    "compilers": [
        "compiler*", "parser", "lexer", "type system", "type checker",
        "type infer*", "borrow checker", "llvm", "codegen", "bytecode",
        "interpreter", "garbage collect*", "gc pause", "monomorphi*",
        "macro expansion", "language server", "incremental compil*",
        "linker", "abi", "ffi", "ast", "lsp", "jit", "build system",
        "static analysis", "lint*", "transpil*", "wasm", "toolchain",
    ],
    "networking": [
        "tcp", "udp", "quic", "http/2", "http/3", "tls", "dns", "bgp",
        "packet loss", "round trip", "rtt", "congestion", "latency",
        "throughput", "bandwidth", "firewall", "vpn", "ipv6",
        "nat travers*", "websocket*", "reverse proxy", "cdn", "load balancer",
        "network partition", "mtu", "socket", "epoll", "io_uring", "timeout*",
    ],
    "ml-infra": [
        "inference", "training run", "gpu", "cuda", "tensor", "embedding*",
        "vector database", "vector search", "quantiz*", "kv cache",
        "batch inference", "model serving", "fine-tun*", "checkpoint*",
        "distributed training", "feature store", "data pipeline",
        "llm", "context window", "rag", "retrieval", "token limit",
        "hallucinat*", "prompt", "gpu memory", "vram", "batching",
    ],
    "os-kernel": [
        "kernel", "syscall", "scheduler", "cgroup*", "namespace", "ebpf",
        "page fault", "mmap", "virtual memory", "numa", "cache line",
        "false sharing", "memory barrier", "lock-free", "mutex", "atomics",
        "context switch", "interrupt", "filesystem", "inode", "device driver",
        "container runtime", "hypervisor", "virtualiz*", "oom", "swap",
    ],
    "observability": [
        "observability", "tracing", "opentelemetry", "otel", "prometheus",
        "cardinality", "log aggregation", "structured log*", "metrics",
        "profiling", "flamegraph", "apm", "datadog", "grafana", "jaeger",
        "alert fatigue", "on-call", "postmortem", "slo", "sli", "pagerduty",
        "root cause", "incident", "dashboards", "log volume", "sampling",
    ],
    "security": [
        "authentication", "authoriz*", "oauth", "jwt", "mtls", "certificate",
        "key rotation", "secret management", "sandbox*", "isolation",
        "supply chain", "sbom", "cve", "vulnerab*", "fuzzing", "memory safety",
        "side channel", "zero trust", "rbac", "capability-based",
    ],
}

# ---- FIXED VALUES: production pain markers (declared order) ----
PAIN_MARKERS: list[str] = [
    "painful", "pain point", "frustrat*", "annoying", "nightmare",
    "broke", "broken", "fails", "failed", "failure", "crash*", "corrupt*",
    "workaround", "kludge", "band-aid",
    "no way to", "there is no", "impossible to", "cannot",
    "doesn't work", "does not work", "gave up", "had to",
    "wasted", "took us", "cost us", "spent days", "spent weeks", "spent months",
    "hard to", "difficult to", "tricky", "gotcha", "footgun",
    "limitation*", "bottleneck", "regression", "edge case",
    "struggl*", "unusable", "brittle", "fragile", "flaky",
    "why is there no", "wish there was", "sorely missing",
]

# ---- FIXED VALUES: story titles that mark noise threads ----
NOISE_TITLES: list[str] = [
    "who wants to be hired", "who is hiring", "freelancer", "seeking work",
    "ask hn: who", "hiring thread",
]

# ---- Fixture lexicon for the driver's invented-prose corpus ----
# (the production lexicon never fires on it; these keep every gate branch live)
FIXTURE_DOMAINS: dict[str, list[str]] = {
    "en": ["the", "and", "for th*"],
    "de": ["der", "und", "die"],
    "fr": ["de la", "les", "pour"],
    "legal": ["licens*", "mit", "apache", "rights", "token"],
}
FIXTURE_PAIN: list[str] = ["is", "was", "are", "that", "for th*", "de", "la", "et",
                           "que", "und", "das", "ist"]

ROTATION = list(DOMAINS)

# ---- FIXED VALUES: search probes of A5; phrases that people write at a wall, and named territory ----
PHRASE_PROBES = [
    "biggest pain point", "we had to build our own", "there is no good solution",
    "wish there was a tool", "surprisingly hard", "the hard part is",
    "spent weeks debugging", "does not scale", "footgun", "why is there no",
    "ended up writing our own", "nobody has solved", "turned out to be much harder",
    "still an unsolved problem", "the tooling is terrible", "hardest bug",
    "took us months", "no one talks about", "the real problem is",
    "everyone runs into", "bit us in production", "silently fails",
    "hard to debug", "does not compose", "leaky abstraction", "worst part about",
]
TERM_PROBES = [
    "kubernetes operational complexity", "observability cost cardinality",
    "distributed tracing overhead", "postgres scaling problems",
    "compiler incremental rebuild slow", "gpu inference latency",
    "kernel scheduler regression", "secret rotation painful",
    "vector database limitations", "consensus implementation bug",
    "network partition data loss", "container cold start",
    "prometheus cardinality explosion", "database migration downtime",
    "connection pool exhausted", "kafka consumer lag rebalance",
    "etcd performance cluster", "grpc streaming backpressure",
    "llm inference batching throughput", "kv cache memory eviction",
    "wasm toolchain debugging", "build system incremental cache",
    "ebpf kernel tracing overhead", "log volume ingestion cost",
    "flaky integration tests distributed", "oauth token refresh race",
    "sqlite concurrency wal", "rust compile time slow",
    "terraform state drift", "memory leak production debugging",
]
