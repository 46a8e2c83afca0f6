"""Fixed values of the event-log diagnosis: signatures, thresholds, severities and scopes."""

SEVERITY_ORDER = ("critical", "high", "medium", "low", "info")
SUCCESS_REASONS = ("Success", "TaskCommitDenied")

# Signature patterns by code, matched without regard to case.
SIGNATURES = {
    "CONTAINER_OOM_OR_137": ("critical", (r"\boomkilled\b", r"exit code 137", r"container.*(?:killed|kill).*memory",
                                          r"killed by yarn for exceeding memory", r"exceed(?:ed|ing).*physical memory", r"memory overhead")),
    "JVM_HEAP_OOM": ("critical", (r"outofmemoryerror", r"java heap space", r"gc overhead limit exceeded", r"requested array size exceeds vm limit")),
    "DIRECT_OR_NATIVE_MEMORY": ("high", (r"direct buffer memory", r"cannot reserve.*direct buffer", r"native memory", r"netty.*memory")),
    "FETCH_FAILED": ("high", (r"fetchfailedexception", r"failed to connect.*shuffle", r"missing an output location for shuffle", r"shuffle block.*not found")),
    "EXECUTOR_LOST": ("high", (r"executordeadexception", r"executor.*lost", r"remote rpc client disassociated", r"container.*lost", r"worker lost")),
}

# A text without any of these words, in lower case, matches no signature; looking for them is cheaper.
ANCHORS = ("oomkilled", "exit code 137", "container", "killed by yarn", "exceed", "memory overhead", "outofmemoryerror", "heap space", "gc overhead",
           "array size", "direct buffer", "native memory", "netty", "fetchfailed", "failed to connect", "missing an output", "shuffle block",
           "executordead", "lost", "disassociated")

# Each text that matches a signature holds one of these three letters in a row, which the keys of a task's event don't.
PIECES = ("xce", "xit", "los", "con", "mki", "p s", "ver", "yer", "buf", "ve ", "net", "g a", "not", "pc ")
# One pass over a text: three classes of letters first, the pieces themselves only where all three fit.
PIECE = "(?i)" + "".join("[" + "".join(sorted({p[i] for p in PIECES})) + "]" for i in range(3)) + "(?<=" + "|".join(PIECES) + ")"

# Where an event line names its event, its stage and the stage's attempt. Fixed by the format of the log.
EVENT_KEY = r'"Event"\s*:\s*"([^"]+)"'
STAGE_KEY = r'"Stage ID"\s*:\s*(-?\d+)'
ATTEMPT_KEY = r'"Stage Attempt ID"\s*:\s*(-?\d+)'

PROPERTY_PREFIXES = ("spark.app.", "spark.executor.", "spark.driver.", "spark.sql.", "spark.memory.", "spark.dynamicAllocation.",
                     "spark.kubernetes.", "spark.shuffle.")

SPILL_BYTES = 1 << 30
GC_WARN, GC_HIGH = 0.10, 0.25
SKEW_RATIO = 5.0
SKEW_MS, SKEW_BYTES = 60_000, 128 << 20
BUSY_MS = 60_000
FETCH_WAIT = 0.2
LARGE_BROADCAST = 512 << 20
FEW_PARTITIONS = 500

# (priority, scope, code): any of the codes opens the scope's plan of that priority.
REMEDIATION = (
    (1, "data-health", "NO_SPARK_EVENTS"), (1, "data-health", "PARSE_ERRORS"), (2, "data-health", "APPLICATION_INCOMPLETE"),
    (5, "write-stall-triage", "TASK_STARTS_WITHOUT_ENDS"), (10, "oom-resolution", "CONTAINER_OOM_OR_137"),
    (11, "oom-resolution", "DIRECT_OR_NATIVE_MEMORY"), (12, "shuffle-recovery", "FETCH_FAILED_AFTER_EXECUTOR_LOSS"),
    (20, "oom-resolution", "JVM_HEAP_OOM"), (20, "oom-resolution", "HIGH_GC_TIME"), (30, "resource-pressure", "HIGH_STAGE_SPILL"),
    (30, "resource-pressure", "INPUT_SKEW"), (30, "resource-pressure", "SHUFFLE_READ_SKEW"), (30, "resource-pressure", "TASK_RUNTIME_SKEW"),
    (30, "resource-pressure", "HIGH_FETCH_WAIT"),
)
FALLBACK = (40, "failure-triage", ("FAILED_JOBS", "FAILED_STAGES"))
