"""Word lists and patterns of the text features. Every function that uses one takes it as a parameter."""

from __future__ import annotations

# The lists and patterns below must be as they are for results to agree.

VAGUE_TERMS = (
    "maybe", "sometimes", "appears", "seems", "probably", "might", "could", "apparently", "likely", "unsure", "perhaps", "possibly", "unclear",
    "uncertain", "somehow", "something", "somewhere", "somewhat", "kind of", "sort of",
)
VAGUE_PHRASES = (r"i\s+think", r"not\s+sure", r"may\s+be", r"could\s+be")
CAUSAL = (
    "because", "since", "so that", "due to", "therefore", "hence", "thus", "consequently", "as a result", "in order to", "if", "when", "whenever",
    "unless", "until", "after", "before", "once", "while",
)
TEMPORAL = ("then", "next", "afterwards", "later", "finally", "subsequently", "eventually", "initially", "first", "second", "third")
OS_TERMS = ("windows", "linux", "ubuntu", "debian", "fedora", "red hat", "mac os", "macos", "os x", "android", "ios")
BROWSER_TERMS = ("chrome", "firefox", "safari", "edge", "internet explorer", "ie11", "ie 11", "opera")
ENV_TERMS = (
    "production", "staging", "qa", "test environment", "development environment", "dev environment", "local environment", "localhost", "server", "client",
    "backend", "front-end", "frontend",
)
POSITIVE_MODALS = ("should", "must", "have to", "need to", "needs to")
NEGATIVE_MODALS = ("should not", "shouldn't", "must not", "mustn't", "cannot", "can't")
HEDGES = ("maybe", "might", "likely", "possibly", "unclear", "unsure", "seems", "appears", "probably", "could", "cannot", "can't", "unknown", "approximately", "guess")
EXCEPTIONS = {
    "null_pointer": ("NullPointerException", "NullReferenceException", "NullPointer"),
    "type_error": ("ClassCastException", "TypeError", "TypeException", "TypeMismatch"),
    "index_error": ("IndexOutOfBoundsException", "ArrayIndexOutOfBoundsException", "IndexError"),
    "io_error": ("IOException", "FileNotFoundException", "SocketException", "EOFException"),
    "runtime_error": ("RuntimeException", "IllegalStateException", "IllegalArgumentException"),
    "concurrency": ("ConcurrentModificationException", "DeadlockException", "InterruptedException"),
    "assertion": ("AssertionError", "AssertionFailedException"),
    "arithmetic": ("ArithmeticException", "DivisionByZero", "NumberFormatException"),
}
LIBRARY_PACKAGES = ("java.", "javax.", "sun.", "com.sun.", "org.apache.", "org.springframework.", "com.google.", "org.junit.", "org.testng.", "scala.", "kotlin.")
STEPS = (r"step\s+\d+", r"step\s+[1-9]", r"reproduce", r"reproduction", r"steps:", r"steps\s+to", r"how\s+to\s+reproduce", r"reproduction\s+steps")
EXPECTED = (r"expected", r"should\s+(?:be|have|do|show|display)", r"but\s+(?:got|received|observed|actual)", r"actual\s+(?:result|output|behavior)", r"instead\s+(?:of|I|we)")
OBSERVED = (r"observed", r"actual", r"got", r"received", r"instead")
AMBIGUITY = {
    "reproduction_ambiguity": ("missing steps", "unclear reproduction", "ambiguous steps", "unclear steps"),
    "input_ambiguity": ("vague inputs", "missing inputs", "unclear parameters", "unclear input"),
    "error_ambiguity": ("unclear error messages", "missing error details", "vague error"),
    "context_ambiguity": ("missing context", "missing environment info", "unclear setup", "missing environment"),
    "behavior_ambiguity": ("unclear expected behavior", "vague description", "unclear behavior"),
}
LAYERS = {
    "ui": ("ui", "gui", "rendering", "display", "view", "frontend", "button", "screen"),
    "logic": ("validation", "calculation", "processing", "algorithm", "logic", "rule"),
    "data": ("database", "query", "storage", "persistence", "sql", "data", "cache"),
    "network": ("http", "api", "request", "connection", "rest", "socket", "network"),
    "infra": ("configuration", "deployment", "logging", "security", "authentication"),
}
BUG_CATEGORIES = (
    "Configuration Issue", "Network Issue", "Database-Related Issue", "GUI-Related Issue", "Performance Issue", "Permission/Deprecation Issue", "Security Issue",
    "Functional Issue", "Test Code-Related Issue",
)
FINE_CATEGORIES = (
    "Exception handling", "Missing case", "Processing", "Typo", "Dependency", "Other (Logic)", "Buffer overflow", "Null pointer dereference",
    "Uninitialized memory read", "Memory leak", "Dangling pointer", "Double free", "Other (Memory)", "Order violation", "Race condition",
    "Atomicity violation", "Deadlock", "Other (Concurrency)",
)
STACKTRACE = r"(?imUd)(?:Exception|Error|Throwable|at\s+[a-zA-Z0-9_.]+\([^)]*\)|^\s*at\s+|Caused\s+by:|Stack\s+trace:)"
CODE = r"(?md)```|(?:public|private|protected|static)\s+(?:class|void|int|String)|(?:^|\n)(?:def|class|import|from\s+\w+\s+import)\s+|(?:^|\n)\s*function\s+\w+\s*\(|#include\s*<|(?:^|\n)\s{4,}\w+.*[;{]"
PATCH = r"(?md)diff --git|\.patch\b|commit [0-9a-f]{6,40}\b|^\+{3}\s+|^-{3}\s+|^@@.*@@"
ENUMERATION = r"(?mUd)(?:^|\n)\s*(?:\d+[.)]|[-*])\s+[A-Z\w]"
VERSION = r"\b(v?\d+\.\d+(?:\.\d+)*(?:_\d+)?)\b"
EXCEPTION_NAME = r"\b([A-Za-z_][A-Za-z0-9_]*(?:Exception|Error|Throwable))\b"
CODE_LIKE = r"\b(stack trace|exception|nullpointer|assert|traceback|line \d+)\b"
