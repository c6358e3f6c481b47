"""The rule catalogue: what each rule tests and what a finding of it says.

Patterns are written in the common ECMAScript / RE2 subset; the compiler turns
them into the exact Java equivalent. ``{name}`` style markers in a text are
filled per finding.
"""

from __future__ import annotations

from dataclasses import dataclass

# Stages, in the order their findings are emitted (and so keep their place
# when a later rule reports the same weakness on the same line).
SCA, NODES, SHARED, SECOND_PASS, HEURISTIC, QUALITY = range(6)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    stage: int
    severity: str
    title: str
    cwe: str | None
    owasp: str | None
    method: str | None
    node_type: str | None
    description: str
    recommendation: str
    category: str = "SECURITY"
    block: int = 0              # rules of one block report line by line together
    scope: str = "all"          # all | js | python | code (js or python)
    skip: tuple[str, ...] = ()  # comment marks that take a line out
    anchors: tuple[str, ...] = ()   # one of these must be in the lower-cased line
    subject: str = "line"       # line | trimmed | code (literals, comments blanked) | statement
    every: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    callee: str | None = None   # tested on the leftmost call
    callee_none: tuple[str, tuple[str, ...]] | None = None  # texts that clear one callee
    instead: tuple[str, str] | None = None  # other pattern, good under a file-level condition
    guard: str | None = None    # name of a file-level condition
    group: str | None = None    # only the first match of a group counts
    call: str | None = None     # name of what must be the case for the first argument of a call


# ---------------------------------------------------------------------------
# Weakness names, categories, patterns and texts of the rules.
# ---------------------------------------------------------------------------
CWE_CREDENTIALS = "CWE-798: Use of Hard-coded Credentials"
CWE_CLEARTEXT = "CWE-312: Cleartext Storage of Sensitive Information"
CWE_SQL = "CWE-89: Improper Neutralization of Special Elements used in an SQL Command"
CWE_EVAL = "CWE-95: Improper Neutralization of Directives in Dynamically Evaluated Code"
CWE_COMMAND = "CWE-78: Improper Neutralization of Special Elements used in an OS Command"
CWE_COMMAND_SHORT = "CWE-78: OS Command Injection"
CWE_DESERIALIZE = "CWE-502: Deserialization of Untrusted Data"
CWE_HASH = "CWE-328: Use of Weak Hash"
CWE_RANDOM = "CWE-338: Use of Cryptographically Weak Pseudo-Random Number Generator"
CWE_RANDOM_PRNG = "CWE-338: Use of Cryptographically Weak Pseudo-Random Number Generator (PRNG)"
CWE_XSS = "CWE-79: Improper Neutralization of Input During Web Page Generation"
CWE_XSS_LONG = "CWE-79: Improper Neutralization of Input During Web Page Generation (XSS)"
CWE_XSS_SHORT = "CWE-79: Cross-Site Scripting (XSS)"
CWE_XSS_LOWER = "CWE-79: Cross-site Scripting"
CWE_CORS = "CWE-942: Permissive Cross-domain Policy with Untrusted Domains"
CWE_PATH = "CWE-22: Improper Limitation of a Pathname to a Restricted Directory"
CWE_PATH_SHORT = "CWE-22: Path Traversal"
CWE_SSRF = "CWE-918: Server-Side Request Forgery (SSRF)"
CWE_DEBUG = "CWE-489: Active Debug Code in Production"
CWE_NOSQL = "CWE-943: Improper Neutralization of Special Elements in Data Query Logic"
CWE_CIPHER = "CWE-327: Use of a Broken or Risky Cryptographic Algorithm"
CWE_SESSION = "CWE-613: Insufficient Session Expiration"
CWE_WORK_FACTOR = "CWE-916: Use of Password Hash with Insufficient Computational Effort"
CWE_DEPENDENCY = "CWE-1395: Dependency on Vulnerable Third-Party Component"

A01 = "A01:2021-Broken Access Control"
A02 = "A02:2021-Cryptographic Failures"
A03 = "A03:2021-Injection"
A05 = "A05:2021-Security Misconfiguration"
A06 = "A06:2021-Vulnerable and Outdated Components"
A07 = "A07:2021-Identification and Authentication Failures"
A08 = "A08:2021-Software and Data Integrity Failures"
A10 = "A10:2021-Server-Side Request Forgery"

HEURISTIC_SKIP = ("//", "#", "/*")
SHARED_SKIP = ("//", "#", "*")
PYTHON_SKIP = ("#",)
NODE_SKIP = ("//", "/*", "*")

AWS_KEY = r"AKIA[0-9A-Z]{16}"
PYTHON_ASSIGN = r"^([a-zA-Z0-9_]+)\s*=\s*(.*)$"
FORMATTED = r"f[\"'].*?\{.*?\}[\"']"
# A string, a call's or an index's brackets (two deep), and what else an operand of + may hold.
_STRING = r"""(?:"[^"\\]*(?:\\.[^"\\]*){0,99}"|'[^'\\]*(?:\\.[^'\\]*){0,99}'|`[^`\\]*(?:\\.[^`\\]*){0,99}`)"""
_ROUND = r"\([^()]*(?:\([^()]*\)[^()]*){0,8}\)"
_SQUARE = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*){0,8}\]"
_OPERAND = r"""[^,()\[\]{}"'`+=<>?:&|;]"""
CONCATENATED = rf"(?:{_OPERAND}*(?:{_STRING}|{_ROUND}|{_SQUARE})){{0,8}}{_OPERAND}*\+(?:[^+=]|$)"
FIRST_ARGUMENT_BUILT = rf"(?:{CONCATENATED}|`[^`]*\$\{{)"
REQUEST_INPUT = r"(?:req\.query|req\.params|req\.body|url_param|user_url)"
# Names of calls whose first argument is looked into.
QUERIES = r"(?:query|execute|rawQuery|executeSql)"
COMMANDS = r"(?:exec|execSync)"
REQUESTS = r"(?:axios\.get|axios\.post|fetch|http\.get|https\.get)"
# A declaration, up to any of its names.
DECLARATION = r"(?:^|[^\w$])(?:const|let|var)\s+(?:[^;]*,\s*)?"
JS_EVAL = r"(?:^|[^\w$.])(?:eval|Function|window\.eval)\s*\("


def _heuristic(rule_id, severity, title, cwe, owasp, description, recommendation, **test):
    return Rule(rule_id, HEURISTIC, severity, title, cwe, owasp, "HEURISTIC", None, description,
                recommendation, skip=HEURISTIC_SKIP, **test)


def _js_node(rule_id, severity, title, cwe, owasp, node_type, description, recommendation, **test):
    test.setdefault("stage", NODES)
    return Rule(rule_id, test.pop("stage"), severity, title, cwe, owasp, "AST", node_type,
                description, recommendation, scope="js", skip=NODE_SKIP, **test)


def _python_node(rule_id, severity, title, cwe, owasp, node_type, description, recommendation, **test):
    test.setdefault("stage", NODES)
    return Rule(rule_id, test.pop("stage"), severity, title, cwe, owasp, "AST", node_type,
                description, recommendation, scope="python", skip=PYTHON_SKIP, **test)


def _shared(rule_id, block, severity, title, cwe, owasp, node_type, description, recommendation, **test):
    return Rule(rule_id, SHARED, severity, title, cwe, owasp, test.pop("method", "AST"), node_type,
                description, recommendation, block=block, scope="code", skip=SHARED_SKIP, **test)


def _quality(rule_id, category, severity, title, description, recommendation):
    return Rule(rule_id, QUALITY, severity, title, None, None, None, None, description,
                recommendation, category=category)


RULES: list[Rule] = [
    # -- dependency analysis ------------------------------------------------
    Rule("D01", SCA, "HIGH", "{title} ({package}@{version})", CWE_DEPENDENCY, A06, "SCA", None,
         "Software Composition Analysis (SCA) detected vulnerable dependency '{package}' at version {version}. {about}",
         "{advice} (Target: >= {fixed})"),
    Rule("D02", SCA, "HIGH", "{title} ({package}=={version})", CWE_DEPENDENCY, A06, "SCA", None,
         "Software Composition Analysis (SCA) detected vulnerable PyPI dependency '{package}' version {version}. {about}",
         "{advice} (Target: >= {fixed})"),
    # -- JavaScript / TypeScript code nodes ---------------------------------
    _js_node("J01", "HIGH", "Arbitrary Code Execution via eval() [AST Verified]", CWE_EVAL, A03,
             "CallExpression (eval)",
             "AST Node: CallExpression ('{callee}') executes arbitrary string expressions with current JavaScript runtime privileges.",
             "Replace eval() with safe JSON.parse() or structured domain data processors.",
             anchors=("eval", "function"), subject="code", every=(JS_EVAL,), none=(r"new\s+Function\s*\(",)),
    _js_node("J02", "CRITICAL", "SQL Injection via Dynamic String Construction [AST Verified]", CWE_SQL, A03,
             "CallExpression ({callee}) -> {detail}",
             "AST Node: CallExpression ('{callee}') with argument of type {detail}. Dynamic user variables concatenated directly into SQL queries risk full database compromise.",
             'Use parameterized queries: db.query("SELECT * FROM users WHERE id = $1", [userId]) or prepared statements.',
             subject="statement", anchors=("+", "${"), call="built_query"),
    _js_node("J03", "CRITICAL", "Command Injection via Shell Execution [AST Verified]", CWE_COMMAND, A03,
             "CallExpression ({callee})",
             "AST Node: CallExpression ('{callee}') executes an unvalidated shell string formed via dynamic concatenation.",
             "Use execFile() or spawn() passing arguments as an array instead of invoking a shell interpreter.",
             subject="statement", anchors=("+", "${"), call="built_command"),
    _js_node("J04", "MEDIUM", "Weak Cryptographic Hash Algorithm ({upper_algorithm}) [AST Verified]", CWE_HASH, A02,
             "CallExpression ({callee} with '{algorithm}')",
             "AST Node: CallExpression ('{callee}') initializes broken hash algorithm '{algorithm}'. Vulnerable to collision attacks.",
             "Migrate to SHA-256 or SHA-512 for data integrity, or bcrypt/Argon2 for passwords.",
             subject="statement", anchors=("createhash",), every=(r"""(?i)createHash\s*\(\s*["']?(md5|sha1)["']?\s*(?:[,)]|$)""",)),
    _js_node("J05", "LOW", "Cryptographically Weak PRNG (Math.random) [AST Verified]", CWE_RANDOM, A02,
             "CallExpression (Math.random)",
             "AST Node: CallExpression (Math.random) is predictable and unsuited for generating authentication tokens, salt, or passwords.",
             "Use crypto.randomBytes() or window.crypto.getRandomValues().",
             anchors=("math.random",), subject="code", every=(r"(?:^|[^\w$.])Math\.random\s*\(",)),
    _js_node("J06", "HIGH", "Potential Server-Side Request Forgery (SSRF) [AST Verified]", CWE_SSRF, A10,
             "CallExpression ({callee} with untrusted input)",
             "AST Node: CallExpression ('{callee}') initiates outbound network requests using untrusted client input '{argument}' without allowlist validation.",
             "Validate target hosts against a strict server-side allowlist and restrict internal private IP ranges (RFC 1918).",
             subject="statement", anchors=("req.", "url_param", "user_url"), call="outer_request"),
    _js_node("J07", "HIGH", "Cross-Site Scripting (DOM XSS via innerHTML) [AST Verified]", CWE_XSS_LONG, A03,
             "BinaryExpression (= to {target})",
             "AST Node: BinaryExpression assigns unescaped data directly to '{target}', exposing web users to script execution.",
             "Use textContent or an HTML sanitization library (DOMPurify.sanitize()).",
             anchors=("innerhtml", "outerhtml"), subject="code",
             every=(r"(?i)(innerHTML|outerHTML)\s*=(?:[^=]|$)",),
             none=(r"(?:^|\s)dangerouslySetInnerHTML\s*=\s*\{",)),
    _js_node("J08", "HIGH", "React dangerouslySetInnerHTML Usage [AST Verified]", CWE_XSS_SHORT, A03,
             "JsxAttribute (dangerouslySetInnerHTML)",
             "AST Node: JsxAttribute dangerouslySetInnerHTML bypasses React built-in XSS protections.",
             "Sanitize content with DOMPurify before passing to dangerouslySetInnerHTML, or use safe standard JSX children.",
             anchors=("dangerouslysetinnerhtml",), every=(r"dangerouslySetInnerHTML\s*=",)),
    _js_node("J09", "CRITICAL", "Exposed AWS Access Key in Variable [AST Verified]", CWE_CREDENTIALS, A07,
             "VariableDeclaration ({name})",
             "AST Node: VariableDeclaration ('{name}') contains a hardcoded AWS Access Key ID literal.",
             "Remove credential from source code and load via AWS IAM roles or environment variables.",
             subject="statement", anchors=("akia",),
             every=(DECLARATION + r"""[\w$]+(?:\s*:\s*[^=]+)?\s*=\s*["'][^"']*""" + AWS_KEY,)),
    _js_node("J10", "HIGH", "Hardcoded Credential in Variable ({name}) [AST Verified]", CWE_CREDENTIALS, A07,
             "VariableDeclaration ({name})",
             "AST Node: VariableDeclaration ('{name}') assigns a sensitive plaintext string credential.",
             "Store sensitive credentials in environment variables or cloud secrets management (e.g. process.env).",
             subject="statement", anchors=("key", "token", "secret", "pass"),
             every=(r"(?i)" + DECLARATION + r"[\w$]*(?:api_?key|secret_?key|auth_?token|jwt_?secret|db_?pass|password)[\w$]*"
                    r"""(?:\s*:\s*[^=]+)?\s*=\s*(?:"[^"]{10,}"|'[^']{10,}')""",),
             none=(AWS_KEY,)),
    # -- Python code nodes: assignments come before calls -------------------
    _python_node("P06", "CRITICAL", "Exposed AWS Access Key in Variable [Python AST Verified]", CWE_CREDENTIALS, A07,
                 "Assign(target='{name}')",
                 "AST Node: Assign(target='{name}') assigns hardcoded AWS access credentials.",
                 'Use AWS IAM Roles or os.environ.get("AWS_ACCESS_KEY_ID").',
                 anchors=("akia",), subject="trimmed", every=(PYTHON_ASSIGN, AWS_KEY), none=(r"^(if|return)",)),
    _python_node("P07", "HIGH", "Hardcoded Credential in Variable ({name}) [Python AST Verified]", CWE_CREDENTIALS, A07,
                 "Assign(target='{name}')",
                 "AST Node: Assign(target='{name}') stores a plaintext secret.",
                 "Load sensitive configurations from environment variables or a key vault.",
                 anchors=("key", "token", "secret", "pass"), subject="trimmed",
                 every=(r"(?i)^[a-zA-Z0-9_]*(api_?key|secret_?key|auth_?token|jwt_?secret|db_?pass|password)[a-zA-Z0-9_]*\s*=",
                        r"""["'][^"'\s]{8,}["']""", r"^.{26,}"),
                 none=(AWS_KEY, r"^(if|return)")),
    _python_node("P01", "CRITICAL", "SQL Injection via Unparameterized Query [Python AST Verified]", CWE_SQL, A03,
                 "Call('{callee}') -> {detail}",
                 "AST Node: Call('{callee}') with interpolated {detail} argument. Raw SQL string formatting allows arbitrary query manipulation.",
                 'Use parameterized SQL queries: cursor.execute("SELECT * FROM users WHERE id = %s", (user_id,))',
                 anchors=("+", 'f"', "f'", ".format(", "%"), subject="trimmed",
                 callee=r"(?i)(cursor\.execute|db\.execute|connection\.execute|execute|raw)$",
                 every=(r" \+ |" + FORMATTED + r"|\.format\(|%s.*%",)),
    _python_node("P02", "CRITICAL", "OS Command Injection via Shell Execution [Python AST Verified]", CWE_COMMAND, A03,
                 "Call('{callee}')",
                 "AST Node: Call('{callee}') initiates shell execution using concatenated input or shell=True.",
                 'Pass arguments as a list: subprocess.run(["ping", "-c", "1", host], check=True) without shell=True.',
                 anchors=("os.system", "subprocess"), subject="trimmed",
                 callee=r"(?i)(os\.system|subprocess\.Popen|subprocess\.call|subprocess\.run)$",
                 every=(r" \+ |" + FORMATTED + r"|shell=True",)),
    _python_node("P03", "HIGH", "Unsafe Deserialization ({callee}) [Python AST Verified]", CWE_DESERIALIZE, A08,
                 "Call('{callee}')",
                 "AST Node: Call('{callee}') deserializes untrusted bytes. Attackers can achieve Remote Code Execution via constructed __reduce__ methods.",
                 "Use safe serialization like JSON, or yaml.safe_load(). Never unpack untrusted pickles.",
                 anchors=("pickle.load", "yaml.load"), subject="trimmed",
                 callee=r"^(pickle\.loads|pickle\.load|yaml\.load)$",
                 callee_none=("yaml.load", ("Loader=SafeLoader", "safe_load"))),
    _python_node("P04", "MEDIUM", "Weak Hash Function ({algorithm}) [Python AST Verified]", CWE_HASH, A02,
                 "Call('{callee}')",
                 "AST Node: Call('{callee}') uses broken digest algorithm {algorithm}.",
                 "Use hashlib.sha256() for data integrity or argon2-cffi / bcrypt for user passwords.",
                 anchors=("hashlib.",), subject="trimmed", callee=r"(?i)(hashlib\.md5|hashlib\.sha1)$"),
    _python_node("P05", "HIGH", "Arbitrary Code Execution via {callee}() [Python AST Verified]", CWE_EVAL, A03,
                 "Call('{callee}')",
                 "AST Node: Call('{callee}') evaluates arbitrary Python source expressions dynamically.",
                 "Use ast.literal_eval() for safe evaluation of literals or parse using json.loads().",
                 anchors=("eval", "exec"), subject="trimmed", callee=r"^(eval|exec)$"),
    # -- shared rules: cross-site scripting ---------------------------------
    _shared("C01", 1, "HIGH", "DOM Cross-Site Scripting (XSS) via Unsanitized innerHTML", CWE_XSS_LONG, A03,
            "PropertyAssignment (innerHTML)",
            "Dynamic assignment to innerHTML/outerHTML without sanitization allows malicious script tags or event handlers to execute in user sessions.",
            "Use safe DOM property textContent, or sanitize untrusted HTML using DOMPurify before inserting.",
            anchors=("innerhtml", "outerhtml"), every=(r"\b(innerHTML|outerHTML)\s*=\s*",),
            none=(r"(?i)DOMPurify\.sanitize", r"(?i)sanitizeHtml", r"""=\s*['"`][^$`]*['"`]\s*;?\s*$""")),
    _shared("C02", 1, "HIGH", "Reflected/Stored XSS via dangerouslySetInnerHTML", CWE_XSS_LOWER, A03,
            "JsxAttribute (dangerouslySetInnerHTML)",
            "Directly rendering HTML strings via dangerouslySetInnerHTML without sanitization exposes components to arbitrary script injection.",
            "Sanitize content with DOMPurify.sanitize() or refactor into structured React JSX components.",
            anchors=("dangerouslysetinnerhtml",),
            every=(r"dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:",), none=(r"(?i)DOMPurify\.sanitize",)),
    _shared("C03", 1, "HIGH", "Unsafe DOM Mutation via document.write()", CWE_XSS_LOWER, A03,
            "CallExpression (document.write)",
            "document.write directly writes unparsed text to the document stream, creating severe XSS risks and blocking document parsing.",
            "Manipulate specific DOM nodes using document.createElement() and node.textContent.",
            anchors=("document.write",), every=(r"document\.(write|writeln)\s*\(",)),
    # -- shared rules: injection --------------------------------------------
    _shared("C04", 2, "CRITICAL", "SQL Injection via Unsanitized Query String Interpolation", CWE_SQL, A03,
            "CallExpression (SQL Execution)",
            "Raw SQL query is assembled dynamically by concatenating variables into SQL statement strings without parameter binding.",
            "Use parameterized queries ($1, ?), prepared statements, or an ORM/query builder.",
            anchors=("+", "${", "%", ".format("),
            every=(r"(?i)(\+\s*([a-zA-Z0-9_.]+|req\.|params\.)|\$\{[^}]+\}|%\s*[a-zA-Z0-9_]+|\.format\()",
                   r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|WHERE)\b|\b(query|execute|rawQuery|executeSql|cursor\.execute)\b"),
            none=(r"\$[1-9]|\?|%s\s*,\s*\[|parameters\s*:",)),
    _shared("C05", 2, "CRITICAL", "OS Command Injection via child_process.exec()", CWE_COMMAND, A03,
            "CallExpression (child_process.exec)",
            "Passing unescaped user-controlled input to a shell command allows adversaries to execute arbitrary system binaries on the host OS.",
            "Use child_process.execFile() or child_process.spawn() with arguments passed strictly as an array.",
            anchors=("exec",),
            every=(r"(?i)(child_process\.(exec|execSync)|exec\s*\(|execSync\s*\()", r"(\+|`|\$\{|req\.|params\.|url)"),
            none=("execFile", "spawn")),
    _shared("C06", 2, "CRITICAL", "Command Injection via os.system()", CWE_COMMAND_SHORT, A03,
            "CallExpression (os.system)",
            "os.system spawns a subshell and executes arbitrary string content. Concatenating variables into command strings grants attackers shell access.",
            'Refactor to subprocess.run(["binary", arg1, arg2], check=True) without shell=True.',
            anchors=("os.system",), every=(r"\bos\.system\s*\(", r"""(\+|%|\.format|\$|f["'])""")),
    _shared("C07", 2, "HIGH", "NoSQL Injection via MongoDB $where Clause", CWE_NOSQL, A03,
            "PropertyAssignment ($where)",
            "The $where operator evaluates arbitrary JavaScript on the MongoDB server. Dynamic string interpolation allows remote JavaScript execution.",
            "Avoid $where clauses and query using strict structured MongoDB operators ($eq, $in, $gt).",
            anchors=("$where",), every=(r"""(?i)\$where\s*:\s*(['"`].*(\+|\$\{)|req\.)""",)),
    # -- shared rules: request forgery --------------------------------------
    _shared("C08", 3, "CRITICAL", "Cloud Metadata Service SSRF Target Detected", CWE_SSRF, A10,
            "Literal (Metadata IP)",
            "Reference to Cloud Instance Metadata Service (169.254.169.254). Adversaries exploit SSRF to harvest temporary IAM credentials and cluster secrets.",
            "Block all outbound requests directed at link-local metadata endpoints (169.254.0.0/16) and enforce IMDSv2.",
            method="HEURISTIC", anchors=("169.254.169.254", "metadata.google.internal"),
            every=(r"(?i)169\.254\.169\.254|metadata\.google\.internal",)),
    _shared("C09", 3, "HIGH", "Server-Side Request Forgery (SSRF) via Unvalidated Outbound Request", CWE_SSRF, A10,
            "CallExpression (HTTP Client)",
            "Server issues outbound HTTP requests to a destination URL directly specified by client parameters without domain allowlisting or private IP blocking.",
            "Validate URLs against an explicit domain allowlist, and block private RFC1918 IPv4 and loopback destinations before issuing network requests.",
            anchors=("req.", "request.", "user_url", "target_url"), guard="no_allowlist",
            every=(r"\b(fetch|axios\.(get|post|request)|http\.(get|request)|urllib\.request|requests\.(get|post))\s*\(",
                   r"\b(req\.(query|body|params)|request\.(args|json|form)|user_url|target_url)\b")),
    # -- shared rules: cryptography -----------------------------------------
    _shared("C10", 4, "HIGH", "Vulnerable Cryptographic Hash Function (MD5/SHA-1)", CWE_HASH, A02,
            "CallExpression (createHash)",
            "MD5 and SHA-1 suffer from proven collision attacks and are broken for cryptographic integrity or credential hashing.",
            "Upgrade to SHA-256/SHA-512 for data integrity, or Argon2id/bcrypt for password hashing.",
            anchors=("createhash", "hashlib."),
            every=(r"""(?i)(createHash\s*\(\s*['"](md5|sha1)['"]|hashlib\.(md5|sha1)\s*\()""",)),
    _shared("C11", 4, "MEDIUM", "Cryptographically Weak Pseudo-Random Generator (Math.random)", CWE_RANDOM_PRNG, A02,
            "CallExpression (Math.random)",
            "Math.random() is deterministic (Xoroshiro128+ algorithm) and predictable. Attackers can predict future security tokens or authentication nonces.",
            "Use crypto.randomBytes() in Node.js or crypto.getRandomValues() in the browser.",
            anchors=("math.random",),
            every=(r"Math\.random\s*\(\)", r"(?i)(token|secret|password|nonce|sessionId|salt|auth)")),
    _shared("C12", 4, "HIGH", "Insecure Cipher Mode (AES-ECB)", CWE_CIPHER, A02,
            "Literal (Cipher Mode)",
            "ECB mode encrypts identical plaintext blocks into identical ciphertext blocks, leaking data patterns and structure.",
            "Use authenticated encryption modes like AES-GCM (Galois/Counter Mode) or ChaCha20-Poly1305 with random nonces.",
            anchors=("aes-",), every=(r"(?i)aes-(128|192|256)-ecb",)),
    # -- shared rules: authentication ---------------------------------------
    _shared("C13", 5, "CRITICAL", "Hardcoded JWT Signing Secret", CWE_CREDENTIALS, A07,
            "CallExpression (jwt.sign)",
            "A static secret literal is passed to jwt.sign(). Anyone with repository access can forge signed tokens and impersonate any user.",
            "Store JWT signing secrets in environment variables (process.env.JWT_SECRET) with at least 256 bits of entropy.",
            anchors=("jwt.sign",), every=(r"""jwt\.sign\s*\([^,]+,\s*['"][a-zA-Z0-9_-]{3,30}['"]\s*[,)]""",)),
    _shared("C14", 5, "MEDIUM", "JWT Issued Without Expiration Time (exp)", CWE_SESSION, A07,
            "CallExpression (jwt.sign)",
            "Tokens issued without an explicit expiration window remain valid indefinitely if intercepted or leaked.",
            'Specify an explicit expiration option: { expiresIn: "1h" } or { expiresIn: "15m" }.',
            anchors=("jwt.sign",), guard="no_expiry", every=(r"jwt\.sign\s*\(",), none=("expiresIn",)),
    _shared("C15", 5, "HIGH", "Insecure CORS Policy with Wildcard & Credentials", CWE_CORS, A01,
            "CallExpression (CORS Config)",
            'Configuring Access-Control-Allow-Origin to "*" alongside credentials allows malicious third-party websites to perform authenticated cross-origin requests.',
            "Restrict CORS origins to a verified allowlist of trusted domains.",
            anchors=("credentials", "access-control-allow-origin"),
            every=(r"""(?i)cors\s*\(\s*\{\s*origin\s*:\s*['"]\*['"]\s*,\s*credentials\s*:\s*true""",),
            instead=(r"""(?i)Access-Control-Allow-Origin['"]\s*,\s*['"]\*['"]""", "credentials_header")),
    _shared("C16", 5, "MEDIUM", "Insufficient Password Hashing Work Factor (Low Salt Rounds)", CWE_WORK_FACTOR, A02,
            "CallExpression (bcrypt.genSalt)",
            "Bcrypt salt rounds below 10 fail to provide adequate resistance against modern GPU/ASIC password cracking attacks.",
            "Increase salt work factor to at least 10 or 12 rounds.",
            anchors=("bcrypt.",), every=(r"bcrypt\.(hash|genSalt)\s*\([^,]+,\s*([1-8])\s*[,)]",)),
    # -- shared rules: files ------------------------------------------------
    _shared("C17", 6, "HIGH", "Path Traversal Vulnerability in File System Operation", CWE_PATH, A01,
            "CallExpression (fs.readFile)",
            'A file read/write operation is supplied an unvalidated user path parameter. Attackers can supply "../" sequences to read arbitrary system files.',
            "Validate paths against a base directory using path.resolve() and verify path.normalize() starts with the allowed root.",
            anchors=("req.", "request."), guard="no_path_cleaning",
            every=(r"\b(fs\.(readFile|readFileSync|createReadStream|unlink|unlinkSync|writeFile|writeFileSync)|open\s*\()\b",
                   r"\b(req\.(query|params|body)|request\.(args|values|form))\b")),
    _shared("C18", 6, "MEDIUM", "Relative Path Traversal Sequence in String Literal", CWE_PATH_SHORT, A01,
            "Literal (Path)",
            'Repeated directory traversal sequence ("../../") detected in path expression. May access files outside intended root.',
            "Use absolute project root resolutions rather than nested relative parent sequences.",
            anchors=("../../",), every=(r"""['"](\.\./){2,}""",), none=("import ", "from ")),
    # -- second pass --------------------------------------------------------
    _js_node("J11", "HIGH", "Arbitrary Code Execution via eval() [AST Verified]", CWE_EVAL, A03,
             "CallExpression (eval)",
             "AST CallExpression Node ({callee}) executes arbitrary string expressions with current runtime privileges.",
             "Replace eval() with safe JSON.parse() or structured domain data processors.",
             stage=SECOND_PASS, anchors=("eval", "function"), subject="code",
             every=(JS_EVAL,), none=(r"new\s+Function\s*\(",)),
    _python_node("P08", "CRITICAL", "Arbitrary Code Execution via Insecure pickle.loads()", CWE_DESERIALIZE, A08,
                 "CallExpression (pickle.loads)",
                 "Python pickle format can construct arbitrary Python objects upon deserialization (__reduce__ method), resulting in full remote code execution (RCE).",
                 "Use safer serialization formats such as json.loads() or protobuf.",
                 stage=SECOND_PASS, anchors=("pickle.load",), every=(r"(pickle|cPickle)\.(loads|load)\s*\(",)),
    _python_node("P09", "HIGH", "Insecure YAML Deserialization via yaml.load()", CWE_DESERIALIZE, A08,
                 "CallExpression (yaml.load)",
                 "yaml.load() without SafeLoader allows arbitrary Python object instantiation via custom YAML tags (!!python/object/apply).",
                 "Use yaml.safe_load(stream) or specify yaml.load(stream, Loader=yaml.SafeLoader).",
                 stage=SECOND_PASS, anchors=("yaml.load",), every=(r"yaml\.load\s*\([^)]*\)",),
                 none=("SafeLoader", "safe_load")),
    _python_node("P10", "CRITICAL", "Subprocess Invocation with shell=True", CWE_COMMAND, A03,
                 "CallExpression (subprocess.run)",
                 "Executing subprocess commands through an underlying system shell (shell=True) allows arguments to inject shell control characters (&, ;, |).",
                 'Pass command arguments as a list (["command", "arg1"]) with default shell=False.',
                 stage=SECOND_PASS, anchors=("subprocess",),
                 every=(r"subprocess\.(Popen|call|run|check_output)\s*\([^)]*shell\s*=\s*True",)),
    _python_node("P11", "HIGH", "Flask Interactive Debugger Enabled (debug=True)", CWE_DEBUG, A05,
                 "CallExpression (app.run)",
                 "Enabling debug=True exposes Werkzeug interactive traceback console which permits unauthenticated remote code execution on uncaught exceptions.",
                 "Ensure debug=False in production deployments and rely on structured error logging.",
                 stage=SECOND_PASS, anchors=("app.run",), every=(r"(?i)app\.run\s*\([^)]*debug\s*=\s*True",)),
    # -- heuristics ---------------------------------------------------------
    _heuristic("H01", "HIGH", "Potential Hard-Coded Secret / API Key", CWE_CREDENTIALS, A07,
               "High-entropy secret or credential appears to be hard-coded in source code instead of using environment variables.",
               "Store sensitive credentials in environment variables (e.g. process.env or .env) or use a dedicated secrets manager (AWS Secrets Manager, GCP Secret Manager).",
               group="secret", anchors=("key", "token", "pass"),
               every=(r"(?i)(api[_-]?key|apikey|secret[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|password|passwd|db[_-]?pass)"
                      r"""\s*[:=]\s*["']([^"'\s]{8,})["']""",)),
    _heuristic("H02", "CRITICAL", "Exposed AWS Access Key ID", CWE_CREDENTIALS, A07,
               "Hardcoded AWS Access Key ID detected. If pushed to version control, cloud infrastructure may be compromised.",
               "Immediately revoke the key in AWS IAM and switch to IAM Roles or ephemeral STS credentials.",
               group="secret", anchors=("akia",), every=(AWS_KEY,)),
    _heuristic("H03", "CRITICAL", "Exposed GitHub Personal Access Token", CWE_CREDENTIALS, A07,
               "A GitHub Personal Access Token was found in source code.",
               "Revoke this token immediately in GitHub settings and load it via secure environment variables.",
               group="secret", anchors=("ghp_", "github_pat_"),
               every=(r"ghp_[0-9a-zA-Z]{36}|github_pat_[0-9a-zA-Z_]{22,}",)),
    _heuristic("H04", "HIGH", "Exposed Slack Webhook URL", CWE_CREDENTIALS, A07,
               "Slack incoming webhook URL found hardcoded, permitting unauthorized message posting.",
               "Store webhook URLs in server-side secret stores.",
               group="secret", anchors=("hooks.slack.com",),
               every=(r"https://hooks\.slack\.com/services/T[0-9a-zA-Z_]+/B[0-9a-zA-Z_]+/[0-9a-zA-Z_]+",)),
    _heuristic("H05", "CRITICAL", "Hardcoded Cryptographic Private Key", CWE_CLEARTEXT, A02,
               "Asymmetric private key material committed directly to repository source.",
               "Remove private keys from source control and store in encrypted key vaults.",
               group="secret", anchors=("private key-----",),
               every=(r"-----BEGIN (RSA|EC|OPENSSH|DSA|PGP) PRIVATE KEY-----",)),
    _heuristic("H06", "CRITICAL", "Potential SQL Injection Risk (Dynamic Query Concatenation)", CWE_SQL, A03,
               "SQL statement constructed dynamically by string concatenation or template literal substitution without parameter binding.",
               "Use parameterized queries / prepared statements (e.g. $1, ?, :param) or an ORM like Prisma / Drizzle / SQLAlchemy.",
               anchors=("+", "${", "%"),
               every=(r"\+\s*[a-zA-Z0-9_.]|\$\{[a-zA-Z0-9_.]|%[sS]",
                      r"(?i)(SELECT\s+.*?\s+FROM|INSERT\s+INTO|UPDATE\s+.*?\s+SET|DELETE\s+FROM)\s*.*?(\+\s*[a-zA-Z0-9_.]+|\$\{[a-zA-Z0-9_.]+\}|%s)"),
               none=(r"\$1", r"\?", ":id")),
    _heuristic("H07", "HIGH", "Arbitrary Code Execution via eval()", CWE_EVAL, A03,
               "Dynamic execution of untrusted input using eval() or new Function() allows full runtime takeover.",
               "Refactor to eliminate dynamic code evaluation. Use JSON.parse() for data interchange or predefined handler mappings.",
               anchors=("eval", "function"),
               every=(r"(?i)\b(eval\s*\([^)]*|new\s+Function\s*\([^)]*|window\.eval\s*\()",)),
    _heuristic("H08", "CRITICAL", "Potential Command Injection Risk", CWE_COMMAND, A03,
               "Operating system command is executed with concatenated user arguments, allowing shell metacharacter execution (; && | `).",
               "Use execFile or subprocess with argument arrays instead of invoking an interactive shell, and validate user input strictly.",
               anchors=("exec", "os.system", "popen"),
               every=(r"""(?i)(exec\s*\(\s*["'`].*?\+|child_process\.exec\s*\(|os\.system\s*\(|subprocess\.Popen\s*\(.*?shell\s*=\s*True)""",)),
    _heuristic("H09", "HIGH", "Potential Unsafe Deserialization / Mass Assignment", CWE_DESERIALIZE, A08,
               "Deserializing untrusted data without schema validation can lead to remote code execution or prototype pollution.",
               "Use safe serialization formats (JSON) and validate inputs with schemas like Zod or Pydantic. Use yaml.safe_load().",
               anchors=("pickle.load", "yaml.load", "unserialize", "object.assign"),
               every=(r"(pickle\.loads|yaml\.load\([^,)]+\)|unserialize\(|Object\.assign\(\s*\{\}\s*,\s*req\.body)",)),
    _heuristic("H10", "MEDIUM", "Weak Cryptographic Hash Algorithm (MD5 / SHA-1)", CWE_HASH, A02,
               "MD5 and SHA-1 have known collision and preimage attacks and must not be used for authentication or passwords.",
               "Use modern hash functions like SHA-256/SHA-512 for integrity, and Argon2id or bcrypt for password hashing.",
               group="crypto", anchors=("createhash", "hashlib.", "messagedigest"),
               every=(r"""(?i)(createHash\s*\(\s*["'](md5|sha1)["']\)|hashlib\.(md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*["'](MD5|SHA-1)["']\))""",)),
    _heuristic("H11", "LOW", "Cryptographically Insecure Pseudorandom Generator", CWE_RANDOM, A02,
               "Math.random() is predictable and unsafe for security-critical tokens, password resets, or session IDs.",
               "Use crypto.randomBytes() (Node.js/Python secrets) or window.crypto.getRandomValues().",
               group="crypto", anchors=("math.random",), every=(r"Math\.random\(\)",)),
    _heuristic("H12", "HIGH", "Cross-Site Scripting (XSS) Risk", CWE_XSS, A03,
               "Directly inserting unsanitized content into the Document Object Model allows script execution.",
               "Use textContent, or sanitize untrusted HTML using DOMPurify before DOM insertion.",
               anchors=("innerhtml", "outerhtml", "document.write"),
               every=(r"(?i)(innerHTML\s*=|outerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML)",)),
    _heuristic("H13", "HIGH", "Insecure CORS Configuration with Wildcard and Credentials", CWE_CORS, A01,
               "Allowing wildcard Access-Control-Allow-Origin with credentials allows any third-party website to make authenticated cross-origin requests.",
               "Specify exact trusted origin domains and avoid wildcard configurations when credentials are supported.",
               anchors=("credentials",),
               every=(r"""(?i)(Access-Control-Allow-Origin['"]\s*,\s*['"]\*['"].*credentials|origin\s*:\s*['"]\*['"].*credentials\s*:\s*true)""",)),
    _heuristic("H14", "HIGH", "Potential Path Traversal in File Access", CWE_PATH, A01,
               "Filesystem operation directly incorporates client-controlled paths without sanitization or path.resolve containment checks.",
               "Sanitize file paths with path.basename() and verify that path.resolve() stays strictly within an approved base directory.",
               anchors=("req.", "request."),
               every=(r"(?i)(fs\.readFileSync|fs\.readFile|open)\s*\(\s*(path\.join\(.*req\.|req\.(query|params|body)|request\.(GET|POST))",)),
    # -- quality and documentation ------------------------------------------
    _quality("Q01", "CODE_QUALITY", "MEDIUM", "Excessive Function Length ({name})",
             "Function '{name}' is {count} lines long, exceeding recommended clean-code threshold (40 lines).",
             "Refactor and decompose into smaller, single-responsibility helper functions to improve testability and readability."),
    _quality("Q02", "MAINTAINABILITY", "MEDIUM", "High Cyclomatic Complexity ({name}: CC {count})",
             "Function '{name}' has high branching complexity ({count} independent decision paths).",
             "Reduce nested branching with guard clauses, polymorphic dispatch, or lookup tables."),
    _quality("Q03", "CODE_QUALITY", "MEDIUM", "Silent Exception Suppression (Empty Catch Block)",
             "Exceptions are caught and discarded without logging or handling, causing silent failures in production.",
             "Log the error with context or rethrow a domain-specific exception to prevent silent data corruption."),
    _quality("Q04", "CODE_QUALITY", "LOW", "Development Debugging Statement Present",
             "Leftover debugging statements (console.log / debugger) can leak internal object structures and pollute runtime logs.",
             "Use a structured logging library with appropriate log levels (debug, info, warn, error) or strip logs during build."),
    _quality("Q05", "DOCUMENTATION", "LOW", "Low Documentation & Comment Density",
             "File has {code} lines of code but only {comments} lines of comments ({ratio}% doc ratio).",
             "Add JSDoc / TypeDoc or PEP 257 docstrings for exported modules, interfaces, and complex algorithms."),
]

# File-level conditions. Each names texts (lower-cased) that switch rules off;
# the last enables the header form of C15.
GUARD_ABSENT = {
    "no_allowlist": ("validateurl", "isallowedhost", "allowlist", "allowed_hosts"),
    "no_path_cleaning": ("path.normalize", "replace(/../"),
}
NO_EXPIRY_TEXT = "expiresIn:"
CREDENTIALS_HEADER = "Access-Control-Allow-Credentials"

# Quality patterns.
FUNCTION_START = (
    r"(?:function\s+([a-zA-Z0-9_$]+)|(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
    r"|def\s+([a-zA-Z0-9_]+)\s*\()"
)
BRANCH = r"\b(if|elif|else if|for|while|case|catch)\b|(\|\||&&|\?)"
EMPTY_CATCH = r"(catch\s*\([^)]*\)\s*\{\s*\}|except\s*:\s*pass)"
DEBUG_TEXTS = ("console.log(", 'print("DEBUG', "debugger;")
QUALITY_SKIP = ("//", "#", "/*", "*")
MAX_FUNCTION_LINES, COMPLEXITY_OFFSET, COMPLEX, VERY_COMPLEX = 45, 15, 10, 15
MIN_CODE_LINES, MIN_COMMENT_RATIO = 50, 0.05

RULE_NUMBER = {rule.rule_id: n for n, rule in enumerate(RULES)}
