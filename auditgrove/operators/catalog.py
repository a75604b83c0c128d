"""The rule catalog: rules, patterns and boolean conditions, as tables and as column expressions.

``RULES`` and ``PATTERNS`` below are fixed values: the pattern texts decide which findings appear. A condition is a nested tuple
``("any" | "all" | "not", term, ...)`` over pattern ids. ``GATES`` names literals, in lower case, one of which every match of the
pattern contains; one pass over a text finds all of them, and a regular expression runs only where one of its own was met. The patterns
below run over batches of texts first (``batch_regex``); Java's then confirms what was found.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rule -> (file, phase, title, version, description, severity, category, confidence)
RULES = {
    "CommandInjection": ("command_injection", "pre", "Advanced Command Injection Detection", "2.1", "Commands, separators, evasion and privilege escalation in item text", "CRITICAL", "command-injection,security,code-execution,privilege-escalation,data-exfiltration,reverse-shell,web-shell,evasion-detection", "HIGH"),
    "SQLInjection": ("sql_injection", "pre", "Advanced SQL Injection Detection", "1.0", "SQL statements, tautologies, timing and error probes in item text", "CRITICAL", "sql-injection,security,database,web-security,data-exfiltration,authentication-bypass", "HIGH"),
    "PathTraversalVulnerability": ("path_traversal", "pre", "Path Traversal Vulnerability", "1.0", "Parent-directory steps and system paths in item text", "HIGH", "path-traversal,security,file-access", None),
    "CrossOriginEscalation": ("cross_origin_escalation", "pre", "Cross-Origin Escalation Detection", "1.0", "Several origins in one item", "HIGH", "cross-origin,escalation,security,multi-domain", "HIGH"),
    "MCPConfigRisk": ("mcp_config_risk", "pre", "MCP Config Risk", "1.0", "Server definition that runs inline code through a shell or interpreter", "CRITICAL", "command-injection,config-risk", None),
    "SecretsLeakage": ("secrets_leakage", "pre", "Secret Exposure", "1.0", "Credentials written out in item text", "HIGH", "secrets,security", "HIGH"),
    "SSHKeyExposure": ("secrets_leakage", "pre", "SSH Key Exposure", "1.0", "SSH keys or key files in item text", "HIGH", "secrets,ssh", "HIGH"),
    "PEMFileAccess": ("secrets_leakage", "pre", "PEM File Access", "1.0", "Certificates or private keys in item text", "HIGH", "secrets,pem", "HIGH"),
    "EnvironmentVariableLeakage": ("secrets_leakage", "pre", "Environment Variable Leakage", "1.0", "Assigned sensitive variables in item text", "MEDIUM", "secrets,environment", "MEDIUM"),
}

#: Rule -> pattern id -> (pattern, ignore case). Every pattern is read by Java and by RE2; \b and \s mean ASCII.
PATTERNS = {
    "CommandInjection": {
        "shell_separators": (r"[;&|`$(){}]\s*[a-zA-Z]", False),
        "command_chaining": (r"(&&|\|\||;|`|\$\()[^)]*\)", False),
        "pipe_operators": (r"\|\s*[a-zA-Z]", False),
        "background_exec": (r"&\s*[a-zA-Z]", False),
        "file_dangerous": (r"(rm\s+-rf?|del\s+.*/[si]|format\s+|dd\s+if|mkfs|fdisk|wipefs)", True),
        "file_manipulation": (r"(chmod\s+777|chown\s+root|chgrp\s+root|touch\s+.*\.sh|echo\s+.*>.*\.sh)", False),
        "process_dangerous": (r"(kill\s+-9|killall|pkill|kill\s+1|shutdown\s+-h|reboot|halt)", False),
        "process_control": (r"(ps\s+aux|top|htop|pstree|pgrep|pidof)", False),
        "network_dangerous": (r"(nc\s+-l|netcat|telnet|ssh\s+-o|wget\s+.*\||curl\s+.*\||ftp\s+get)", False),
        "network_tools": (r"(nmap|nslookup|dig|ping\s+-c|traceroute|route\s+add)", False),
        "exec_functions": (r"\b(system|exec|popen|spawn|eval|shell_exec|passthru|proc_open)\b", False),
        "python_exec": (r"\b(os\.system|subprocess\.|exec\(|eval\(|compile\(|execfile\(|input\(\))\b", False),
        "node_exec": (r"\b(child_process\.|exec\(|spawn\(|execSync\(|spawnSync\(|require\(|eval\(\))\b", False),
        "php_exec": (r"\b(shell_exec|exec|system|passthru|proc_open|popen|eval|assert|create_function)\b", False),
        "java_exec": (r"\b(Runtime\.getRuntime\(\)\.exec|ProcessBuilder|ScriptEngine|eval\(|exec\(\))\b", False),
        "encoding_evasion": (r"(base64\s+-d|base64\s+decode|echo\s+.*\||printf\s+.*\||xxd\s+-r)", False),
        "obfuscation": (r"(eval\s+\$|eval\s+`|eval\s+\$\(|eval\s+base64|eval\s+printf)", False),
        "variable_substitution": (r"\$\{[^}]+\}|\$\([^)]+\)", False),
        "injection_patterns": (r"(\$\{[^}]+\}|\$\([^)]+\)|`[^`]+`|eval\s+.*\$|exec\s+.*\$|system\s+.*\$)", False),
        "privilege_escalation": (r"(sudo\s+.*|su\s+.*|chmod\s+4755|chmod\s+6755|setuid|setgid)", False),
        "data_exfil": (r"(cat\s+.*\.(passwd|shadow|config|env|key|pem|p12|pfx)|grep\s+.*password|find\s+.*-name\s+.*\.(key|pem|p12))", False),
        "reverse_shell": (r"(bash\s+-i\s*>\s*&|nc\s+-e|telnet\s+.*|/bin/bash\s+-i|/bin/sh\s+-i)", False),
        "web_shell": (r"(php\s+-r|python\s+-c|perl\s+-e|ruby\s+-e|node\s+-e)", False),
        "suspicious_combo": (r"(rm\s+.*&&|del\s+.*&&|format\s+.*&&|kill\s+.*&&|shutdown\s+.*&&)", False),
        "unsafe_file_ops": (r"(rm\s+-rf|rm\s+.*-r|dd\s+if=|format\s+[A-Za-z]:|del\s+.*/s|rmdir\s+.*/s)", False),
        "dangerous_permissions": (r"(chmod\s+777|chown\s+root|sudo\s+rm)", False),
        "wildcard_patterns": (r"(\*\.\*|\*\*/\*)", False),
        "legitimate_patterns": (r"(create_file|update_file|read_file|write_file|push_files|git_|file_|add_comment|list_commits)", False),
    },
    "SQLInjection": {
        "sql_keywords": (r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE|UNION|OR|AND|WHERE|FROM|HAVING|GROUP BY|ORDER BY|LIMIT|OFFSET)\b", True),
        "sql_comments": (r"(--|#|/\*|\*/|;--|;#|;/\*|;\*/)", False),
        "inline_comments": (r"(--\s*$|#\s*$|/\*\s*$|\*/\s*$)", False),
        "union_injection": (r"\b(UNION\s+ALL\s+SELECT|UNION\s+SELECT|UNION\s+ALL)\b", True),
        "union_columns": (r"\b(UNION\s+SELECT\s+[^;]+FROM|UNION\s+SELECT\s+[^;]+WHERE|UNION\s+SELECT\s+[^;]+GROUP BY)\b", True),
        "boolean_injection": (r"\b(OR\s+1=1|OR\s+'1'='1'|OR\s+TRUE|AND\s+1=1|AND\s+'1'='1'|AND\s+TRUE|OR\s+1|AND\s+1)\b", True),
        "boolean_operators": (r"\b(OR\s+[0-9]+=[0-9]+|AND\s+[0-9]+=[0-9]+|OR\s+[a-zA-Z]+=[a-zA-Z]+|AND\s+[a-zA-Z]+=[a-zA-Z]+)\b", True),
        "time_injection": (r"\b(SLEEP\s*\(|BENCHMARK\s*\(|WAITFOR\s+DELAY|PG_SLEEP\s*\(|DBMS_PIPE\.RECEIVE_MESSAGE)\b", True),
        "delay_patterns": (r"\b(SLEEP\s*\([0-9]+\)|BENCHMARK\s*\([0-9]+|WAITFOR\s+DELAY\s+'[0-9:]+'|PG_SLEEP\s*\([0-9]+\))\b", True),
        "error_injection": (r"\b(AND\s+UPDATEXML|AND\s+EXTRACTVALUE|AND\s+FLOOR|AND\s+CONVERT|AND\s+CAST|AND\s+CONCAT)\b", True),
        "error_functions": (r"\b(UPDATEXML\s*\(|EXTRACTVALUE\s*\(|FLOOR\s*\(|CONVERT\s*\(|CAST\s*\(|CONCAT\s*\()\b", True),
        "stacked_queries": (r"(;\s*SELECT|;\s*INSERT|;\s*UPDATE|;\s*DELETE|;\s*DROP|;\s*CREATE|;\s*ALTER|;\s*EXEC|;\s*EXECUTE)\b", True),
        "multiple_statements": (r"(SELECT\s+.*;\s*SELECT|INSERT\s+.*;\s*SELECT|UPDATE\s+.*;\s*SELECT|DELETE\s+.*;\s*SELECT)\b", True),
        "mysql_injection": (r"\b(INFORMATION_SCHEMA|mysql\.|@@version|@@hostname|@@datadir|@@basedir|@@tmpdir|@@slave_load_tmpdir)\b", True),
        "postgresql_injection": (r"\b(pg_catalog|information_schema|current_database|current_user|session_user|version|pg_stat_activity)\b", True),
        "mssql_injection": (r"\b(sys\.|sysobjects|syscolumns|sysdatabases|@@version|@@servername|@@language|@@spid)\b", True),
        "oracle_injection": (r"\b(ALL_TABLES|ALL_USERS|ALL_INDEXES|ALL_CONSTRAINTS|USER_TABLES|USER_USERS|V\$|DBA_)\b", True),
        "encoding_evasion": (r"(%27|%22|%3B|%2D%2D|%23|%2F%2A|%2A%2F|%3C%3E|%3D|%3C|%3E)", True),
        "hex_encoding": (r"(0x[0-9a-fA-F]+|\\x[0-9a-fA-F]+|\\u[0-9a-fA-F]{4})", True),
        "unicode_encoding": (r"(\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})", True),
        "case_variation": (r"(select|insert|update|delete)", True),
        "orm_bypass": (r"\b(OR\s+1\s*=\s*1|AND\s+1\s*=\s*1|OR\s+TRUE|AND\s+TRUE|OR\s+'1'\s*=\s*'1'|AND\s+'1'\s*=\s*'1')\b", True),
        "parameter_bypass": (r"\b(OR\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[a-zA-Z_][a-zA-Z0-9_]*|AND\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[a-zA-Z_][a-zA-Z0-9_]*)\b", True),
        "auth_bypass": (r"\b(OR\s+1\s*=\s*1\s*--|OR\s+'1'\s*=\s*'1'\s*--|OR\s+TRUE\s*--|AND\s+1\s*=\s*1\s*--|AND\s+'1'\s*=\s*'1'\s*--)\b", True),
        "login_bypass": (r"\b(admin'--|admin'#|admin'/\*|' OR '1'='1|' OR 1=1|' OR TRUE|' AND '1'='1|' AND 1=1)\b", True),
        "data_exfil": (r"\b(SELECT\s+.*FROM\s+.*WHERE|SELECT\s+.*FROM\s+.*LIMIT|SELECT\s+.*FROM\s+.*OFFSET)\b", True),
        "sensitive_data": (r"\b(SELECT\s+.*password|SELECT\s+.*passwd|SELECT\s+.*secret|SELECT\s+.*key|SELECT\s+.*token|SELECT\s+.*credential)\b", True),
        "blind_injection": (r"\b(AND\s+1\s*=\s*1|AND\s+'1'\s*=\s*'1'|AND\s+TRUE|OR\s+1\s*=\s*1|OR\s+'1'\s*=\s*'1'|OR\s+TRUE)\b", True),
        "conditional_logic": (r"\b(IF\s*\(|CASE\s+WHEN|WHEN\s+.*\s+THEN|ELSE|END\s+IF|END\s+CASE)\b", True),
        "legitimate_patterns": (r"(database_tool|sql_client|query_builder|orm_tool|migration_tool|backup_tool|replication_tool|monitoring_tool|analytics_tool|reporting_tool)", False),
        "safe_keywords": (r"(SELECT\s+tool|INSERT\s+tool|UPDATE\s+tool|DELETE\s+tool|CREATE\s+tool|ALTER\s+tool)", False),
    },
    "PathTraversalVulnerability": {
        "dot_dot_slash": (r"\.\./", False),
        "dot_dot_backslash": (r"\.\.\\", False),
        "encoded_dot_dot": (r"%2e%2e%2f", True),
        "double_encoded": (r"%252e%252e%252f", True),
        "etc_path": (r"/etc/", False),
        "root_path": (r"/root/", False),
        "var_path": (r"/var/", False),
        "proc_path": (r"/proc/", False),
        "sys_path": (r"/sys/", False),
        "windows_system": (r"[Cc]:[\\/][Ww]indows[\\/]", False),
        "windows_users": (r"[Cc]:[\\/][Uu]sers[\\/]", False),
        "file_read": (r"file_get_contents|readFile|fopen|open\s*\(", False),
        "file_include": (r"include|require|import", False),
    },
    "CrossOriginEscalation": {
        "multi_domain_1": (r"https?://([a-zA-Z0-9.-]+\.[a-zA-Z]{2,}).*https?://([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", False),
        "mixed_local_remote_1": (r"https?://(localhost|127\.0\.0\.1|0\.0\.0\.0).*https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", False),
        "mixed_local_remote_2": (r"https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}.*https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)", False),
        "port_escalation": (r"https?://[a-zA-Z0-9.-]+:\d+.*https?://[a-zA-Z0-9.-]+:\d+", False),
        "mixed_schemes_1": (r"https://.*http://", False),
        "mixed_schemes_2": (r"http://.*https://", False),
        "mixed_ws_schemes": (r"wss://.*ws://", False),
        "subdomain_variations": (r"https?://[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}.*https?://[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", False),
        "api_multi_domain": (r"/api/.*https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}.*/api/", False),
        "proxy_patterns": (r"(proxy|redirect|forward).*https?://.*https?://", True),
        "url_in_params": (r"[?&](url|redirect|forward|proxy)=https?://.*https?://", True),
        "service_domains": (r"(api\.|auth\.|admin\.|secure\.).*\.(com|net|org|io).*\.(com|net|org|io)", True),
        "tool_multi_origin": (r'"(baseUrl|endpoint|url|host)".*https?://.*"(baseUrl|endpoint|url|host)".*https?://', True),
        "url_array": (r'\[.*"https?://[^"]*".*,.*"https?://[^"]*".*\]', False),
        "json_multi_origin": (r'"origin".*:.*"https?://.*"origin".*:.*"https?://', True),
        "legitimate_cdn": (r"(cdn\.|static\.|assets\.|media\.)", True),
        "legitimate_backup": (r"(backup|fallback|mirror)", True),
        "legitimate_loadbalancer": (r"(lb\.|loadbalancer|ha\.)", True),
    },
    "MCPConfigRisk": {
        "cmd_exec": (r"COMMAND:\s*(bash|sh|cmd|pwsh|powershell|python(\d+(\.\d+)?)?|node)\b", True),
        "calc_exec": (r"COMMAND:\s*calc\.exe\b", True),
        "arg_flag": (r"ARGS:\s*.*(-c|-e)\b", True),
        "arg_tokens": (r"ARGS:\s*.*(curl|wget|base64|nc\s|telnet|\|\s*sh|\|\s*bash|&&)", True),
    },
    "SecretsLeakage": {
        "assigned_secret": (r"(api[_-]?key|secret|token|passwd|password)[\"']?\s*[:=]\s*[\"'][A-Za-z0-9+/_.-]{12,}[\"']", True),
        "access_key_id": (r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", False),
        "hosting_token": (r"\b(ghp|gho|ghs|ghr)_[A-Za-z0-9]{36}\b", False),
        "bearer_header": (r"authorization:\s*bearer\s+[A-Za-z0-9._-]{16,}", True),
    },
    "SSHKeyExposure": {
        "ssh_directory": (r"(~|/home/[A-Za-z0-9_.-]+|/root)/\.ssh/", False),
        "ssh_key_file": (r"\bid_(rsa|dsa|ecdsa|ed25519)\b", False),
        "ssh_public_key": (r"\bssh-(rsa|ed25519)\s+AAAA[0-9A-Za-z+/]+", False),
    },
    "PEMFileAccess": {
        "pem_block": (r"-----BEGIN [A-Z ]*(PRIVATE KEY|CERTIFICATE)-----", False),
        "pem_file": (r"[A-Za-z0-9_-]+\.(pem|p12|pfx|key)\b", False),
    },
    "EnvironmentVariableLeakage": {
        "assigned_variable": (r"\b[A-Z][A-Z0-9_]*(KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*\s*=\s*[^\s$<{]{6,}", False),
        "env_file": (r"(^|[\s/\"'])\.env(\.[a-z]+)?\b", False),
    },
}

CONDITIONS = {
    "CommandInjection": (
        "any",
        ("all", "shell_separators", ("any", "file_dangerous", "process_dangerous", "network_dangerous")),
        "file_manipulation", "process_control", "network_tools", "command_chaining", "pipe_operators", "background_exec",
        ("all", ("any", "exec_functions", "python_exec", "node_exec", "php_exec", "java_exec"), ("not", "legitimate_patterns")),
        ("all", ("any", "encoding_evasion", "obfuscation"), "shell_separators"),
        "variable_substitution", "injection_patterns", "privilege_escalation", "data_exfil", "reverse_shell", "web_shell", "unsafe_file_ops",
        "dangerous_permissions", "wildcard_patterns", "suspicious_combo",
    ),
    "SQLInjection": (
        "any",
        "union_injection", "union_columns", "time_injection", "delay_patterns", "error_injection", "error_functions", "stacked_queries",
        "multiple_statements", "auth_bypass", "login_bypass", "sensitive_data",
        ("all", ("any", "boolean_injection", "boolean_operators", "orm_bypass", "parameter_bypass", "blind_injection"), ("not", "legitimate_patterns")),
        ("all", "data_exfil", ("not", "safe_keywords")),
        # a keyword has no gate and stands in nearly every text, so what is gated is asked first
        ("all", ("any", "sql_comments", "inline_comments", "boolean_injection", "mysql_injection", "postgresql_injection", "mssql_injection", "oracle_injection", "encoding_evasion", "hex_encoding", "unicode_encoding", "case_variation", "conditional_logic"), "sql_keywords"),
    ),
    # reading or including a file decides nothing: every such term holds a parent-directory step, which decides alone
    "PathTraversalVulnerability": ("any", "dot_dot_slash", "dot_dot_backslash", "encoded_dot_dot", "double_encoded", "etc_path", "root_path", "var_path", "proc_path", "sys_path", "windows_system", "windows_users"),
    "CrossOriginEscalation": (
        "any",
        ("all", "multi_domain_1", ("not", ("any", "legitimate_cdn", "legitimate_backup", "legitimate_loadbalancer"))),
        "mixed_local_remote_1", "mixed_local_remote_2", "port_escalation", "mixed_schemes_1", "mixed_schemes_2", "mixed_ws_schemes", "subdomain_variations",
        "api_multi_domain", "proxy_patterns", "url_in_params", "service_domains", "tool_multi_origin", "url_array", "json_multi_origin",
    ),
    "MCPConfigRisk": ("any", ("all", "cmd_exec", ("any", "arg_flag", "arg_tokens")), "calc_exec"),
    "SecretsLeakage": ("any", "assigned_secret", "access_key_id", "hosting_token", "bearer_header"),
    "SSHKeyExposure": ("any", "ssh_directory", "ssh_key_file", "ssh_public_key"),
    "PEMFileAccess": ("any", "pem_block", "pem_file"),
    "EnvironmentVariableLeakage": ("any", "assigned_variable", "env_file"),
}

#: Literals (lower case; a blank stands for any white space) of which a text must hold one before the pattern can match.
GATES = {
    "CommandInjection": {
        "shell_separators": (";", "&", "|", "`", "$", "(", ")", "{", "}"), "command_chaining": (")",), "pipe_operators": ("|",), "background_exec": ("&",),
        "file_dangerous": ("rm ", "del ", "format ", "dd ", "mkfs", "fdisk", "wipefs"), "file_manipulation": ("chmod ", "chown ", "chgrp ", "touch ", "echo "),
        "process_dangerous": ("kill ", "killall", "pkill", "shutdown ", "reboot", "halt"), "process_control": ("ps ", "top", "pstree", "pgrep", "pidof"),
        "network_dangerous": ("nc ", "netcat", "telnet", "ssh ", "wget ", "curl ", "ftp "), "network_tools": ("nmap", "nslookup", "dig", "ping ", "traceroute", "route "),
        "exec_functions": ("system", "exec", "popen", "spawn", "eval", "passthru", "proc_open"), "python_exec": ("os.system", "subprocess.", "exec(", "eval(", "compile(", "execfile(", "input("),
        "node_exec": ("child_process.", "exec(", "spawn(", "sync(", "require(", "eval("), "php_exec": ("exec", "system", "passthru", "popen", "proc_open", "eval", "assert", "create_function"),
        "java_exec": ("runtime.", "processbuilder", "scriptengine", "eval(", "exec("), "encoding_evasion": ("base64 ", "echo ", "printf ", "xxd "), "obfuscation": ("eval ",),
        "variable_substitution": ("${", "$("), "injection_patterns": ("${", "$(", "`", "eval ", "exec ", "system "), "privilege_escalation": ("sudo ", "su ", "chmod ", "setuid", "setgid"), "data_exfil": ("cat ", "grep ", "find "),
        "reverse_shell": ("bash ", "nc ", "telnet", "/bin/sh "), "web_shell": ("php ", "python ", "perl ", "ruby ", "node "), "suspicious_combo": ("&&",), "unsafe_file_ops": ("rm ", "dd ", "format ", "del ", "rmdir "),
        "dangerous_permissions": ("chmod ", "chown ", "sudo "), "wildcard_patterns": ("*",), "legitimate_patterns": ("_file", "push_files", "git_", "file_", "add_comment", "list_commits"),
    },
    "SQLInjection": {
        "sql_comments": ("--", "#", "/*", "*/"), "inline_comments": ("--", "#", "/*", "*/"), "union_injection": ("union ",), "union_columns": ("union ",), "boolean_injection": (" 1", " '", " true"),
        "boolean_operators": ("=",), "time_injection": ("sleep", "benchmark", "waitfor ", "dbms_pipe"), "delay_patterns": ("sleep", "benchmark", "waitfor "),
        "error_injection": ("updatexml", "extractvalue", "floor", "convert", "cast", "concat"), "error_functions": ("updatexml", "extractvalue", "floor", "convert", "cast", "concat"),
        "stacked_queries": (";",), "multiple_statements": (";",), "mysql_injection": ("information_schema", "mysql.", "@@"), "postgresql_injection": ("pg_", "information_schema", "current_", "session_user", "version"),
        "mssql_injection": ("sys.", "sysobjects", "syscolumns", "sysdatabases", "@@"), "oracle_injection": ("all_", "user_", "v$", "dba_"), "encoding_evasion": ("%",), "hex_encoding": ("0x", "\\x", "\\u"), "unicode_encoding": ("\\u",),
        "case_variation": ("select", "insert", "update", "delete"), "orm_bypass": (" 1", " '", " true"), "parameter_bypass": ("=",), "auth_bypass": ("--",), "login_bypass": ("'",), "data_exfil": ("select ",),
        "sensitive_data": ("select ",), "blind_injection": (" 1", " '", " true"), "conditional_logic": ("if(", " (", " when", "when ", "else", " if", " case"), "legitimate_patterns": ("_tool", "sql_client", "query_builder"), "safe_keywords": (" tool",),
    },
    "PathTraversalVulnerability": {
        "dot_dot_slash": ("../",), "dot_dot_backslash": ("..\\",), "encoded_dot_dot": ("%2e",), "double_encoded": ("%252e",), "etc_path": ("/etc/",), "root_path": ("/root/",), "var_path": ("/var/",),
        "proc_path": ("/proc/",), "sys_path": ("/sys/",), "windows_system": ("windows",), "windows_users": ("users",), "file_read": ("file_get_contents", "readfile", "open"), "file_include": ("include", "require", "import"),
    },
    "CrossOriginEscalation": dict.fromkeys([k for k in PATTERNS["CrossOriginEscalation"] if not k.startswith("legitimate")], ("://",)) | {
        "mixed_local_remote_1": ("://localhost", "://127.0.0.1", "://0.0.0.0"), "mixed_local_remote_2": ("://localhost", "://127.0.0.1", "://0.0.0.0"), "mixed_schemes_1": ("http://",), "mixed_schemes_2": ("http://",), "mixed_ws_schemes": ("wss://",),
        "api_multi_domain": ("/api/",), "proxy_patterns": ("proxy", "redirect", "forward"), "url_in_params": ("=http",), "tool_multi_origin": ('"baseurl"', '"endpoint"', '"url"', '"host"'), "url_array": ('"http',), "json_multi_origin": ('"origin"',),
        "service_domains": ("api.", "auth.", "admin.", "secure."), "legitimate_cdn": ("cdn.", "static.", "assets.", "media."), "legitimate_backup": ("backup", "fallback", "mirror"), "legitimate_loadbalancer": ("lb.", "loadbalancer", "ha."),
    },
    "MCPConfigRisk": {"cmd_exec": ("command:",), "calc_exec": ("command:",), "arg_flag": ("args:",), "arg_tokens": ("args:",)},
    "SecretsLeakage": {"assigned_secret": ("key", "secret", "token", "passw"), "access_key_id": ("akia", "asia"), "hosting_token": ("ghp_", "gho_", "ghs_", "ghr_"), "bearer_header": ("bearer",)},
    "SSHKeyExposure": {"ssh_directory": (".ssh/",), "ssh_key_file": ("id_",), "ssh_public_key": ("ssh-",)},
    "PEMFileAccess": {"pem_block": ("-----begin",), "pem_file": (".pem", ".p12", ".pfx", ".key")},
    "EnvironmentVariableLeakage": {"assigned_variable": ("key", "token", "secret", "password"), "env_file": (".env",)},
}


class Catalog(NamedTuple):
    """Rules, patterns, conditions and gates, keyed by rule; gates may be missing."""

    rules: dict[str, tuple]
    patterns: dict[str, dict[str, tuple[str, bool]]]
    conditions: dict
    gates: dict[str, dict[str, tuple[str, ...]]]


BUILT_IN = Catalog(RULES, PATTERNS, CONDITIONS, GATES)
META = ("rule_file", "phase", "name", "version", "description", "severity", "category", "confidence")
STORED = "rule string, " + ", ".join(f"{m} string" for m in META) + ", patterns array<struct<pattern_id:string,regex:string,nocase:boolean,gate:array<string>>>, condition string"

WORD = "[0-9A-Za-z_]"
#: White space other than the blank, which stands for all of it in gate literals.
WHITE = "\t\n\x0b\x0c\r"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that is one group as a whole or leads with one; else the pattern itself."""
    if not pattern.startswith("(") or pattern.startswith("(?"):
        return [pattern]
    parts, depth, start, i = [], 0, 1, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[":
            i = pattern.index("]", i + 2)
        elif ch == "(":
            depth += 1
        elif ch in "|)" and depth == 1:
            parts.append(pattern[start:i])
            start = i + 1
            if ch == ")":
                return [pattern] if pattern[i + 1 : i + 2] in ("?", "*", "{") else parts
        elif ch == ")":
            depth -= 1
        i += 2 if ch == "\\" else 1
    return [pattern]


def java_regex(pattern: str, nocase: bool) -> str:
    """The pattern for Spark: only a newline ends a line, and a word boundary is an ASCII one; before what surely begins with a word's character it is one look back."""
    plain = not re.search(r"\\\]|\[\^?\]|\\Q", pattern)  # brackets that only a real parser reads
    word = plain and pattern.startswith(r"\b") and all(re.match(rf"{WORD}(?![?*{{])", a) for a in alternatives(pattern[2:]))
    lead, rest = (f"(?<!{WORD})", pattern[2:]) if word else ("", pattern)
    return ("(?di)" if nocase else "(?d)") + lead + rest.replace(r"\b", BOUNDARY)


def batch_regex(pattern: str, nocase: bool) -> str:
    """The pattern for Arrow (RE2), which finds all that Java's finds: white space has the vertical tab too, and letters without case are more."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        part = pattern[i : i + (2 if pattern[i] == "\\" else 1)]
        inside = part == "[" or (inside and part != "]")
        out.append(part if part != r"\s" else r"\t-\r " if inside else r"[\t-\r ]")
        i += len(part)
    return ("(?i)" if nocase else "") + "".join(out)


def batch_name(rule: str, pattern_id: str, catalog: Catalog) -> str | None:
    """The name under which a batch tells of a pattern; only those of ``PATTERNS`` are known to be read alike by both engines."""
    return f"{rule}.{pattern_id}" if catalog.patterns[rule][pattern_id] == PATTERNS.get(rule, {}).get(pattern_id) else None


def rules_of(phase: str | None = None, catalog: Catalog = BUILT_IN) -> list[str]:
    return [r for r, v in catalog.rules.items() if phase is None or v[1] == phase]


def gate_literals(catalog: Catalog = BUILT_IN, rules: list[str] | None = None) -> list[str]:
    """All literals of the gates of some rules (of all, if none are named)."""
    return sorted({blank(g) for r in (catalog.rules if rules is None else rules) for gate in catalog.gates.get(r, {}).values() for g in gate if g})


def blank(literal: str) -> str:
    return literal.translate({ord(ch): " " for ch in WHITE})


#: So many groups of literals are sought at first, and within a group that a text holds.
GROUPS = 6
#: So many texts of a batch tell which literals are common (met in one of ``COMMON`` texts); those are sought alone.
FIRST_TEXTS, COMMON = 200, 50


def find_literals(literals: list[str], patterns: list[tuple[str, str, tuple[str, ...]]] = (), shown: list[str] | None = None) -> Callable[[pa.Array], pa.Array]:
    """A function that lists the literals (those ``shown``, or all) in each of a batch of texts, and the names of the patterns found.

    An automaton reads a text once for many literals, and only the texts in which it finds one are read again for parts of its literals. A pattern
    (name, regular expression, gate) then reads the texts with a literal of its gate, or all if it has none.
    The function refers to nothing of this package, so workers need not import it.
    """
    told = literals if shown is None else shown
    lower = pc.ascii_lower if all(map(str.isascii, literals)) else pc.utf8_lower

    def literal_pattern(words: list[str]) -> str:
        return "|".join(re.escape(w).replace("\\ ", r"[ \t-\r]") for w in words)

    def seek(texts: pa.Array, rows: np.ndarray, words: list[str], found: dict[str, np.ndarray]) -> None:
        for i in range(min(GROUPS, len(words))):
            part = words[i::GROUPS]
            hit = pc.fill_null(pc.match_substring_regex(texts, literal_pattern(part)), False)
            at = rows[np.asarray(hit)]
            if len(part) == 1:
                found[part[0]] = at
            elif len(at):
                seek(texts.filter(hit), at, part, found)

    def match(texts: pa.Array, found: dict[str, np.ndarray], regex: str, gate: tuple[str, ...]) -> np.ndarray:
        at = np.ones(len(texts), bool)
        if gate:
            at[:] = False
            for w in gate:
                at[found.get(w, np.empty(0, np.int64))] = True
        rows = np.flatnonzero(at)
        if not len(rows):
            return rows
        hit = pc.match_substring_regex(texts if len(rows) == len(texts) else texts.filter(pa.array(at)), regex)
        return rows[np.asarray(pc.fill_null(hit, False))]

    def run(raw: pa.Array) -> pa.Array:
        texts, found = lower(raw), {}
        seek(texts.slice(0, FIRST_TEXTS), np.arange(min(len(texts), FIRST_TEXTS)), literals, found)
        if len(texts) > FIRST_TEXTS:
            common = [w for w in literals if COMMON * len(found.get(w, ())) >= FIRST_TEXTS]
            rest, rows, more = texts.slice(FIRST_TEXTS), np.arange(FIRST_TEXTS, len(texts)), {}
            for part in [[w] for w in common] + [[w for w in literals if w not in set(common)]]:
                if part:
                    seek(rest, rows, part, more)
            found = {w: np.concatenate([d[w] for d in (found, more) if w in d]) for w in literals if w in found or w in more}
        hits = {name: match(raw, found, regex, gate) for name, regex, gate in patterns}
        for w in told:  # one that stands there only as the beginning of longer ones is told by them
            longer = [x for x in told if x != w and x.startswith(w) and len(found.get(x, ()))]
            if longer and len(found.get(w, ())):
                alone = re.compile(f"{literal_pattern([w])}(?!{literal_pattern([x[len(w):] for x in longer])})".encode())
                both = np.isin(found[w], np.concatenate([found[x] for x in longer]))
                found[w] = found[w][[not b or alone.search(texts[int(i)].as_buffer()) is not None for i, b in zip(found[w], both)]]
        hits |= {w: found.get(w, np.empty(0, np.int64)) for w in told}
        rows = np.concatenate([np.empty(0, np.int64), *hits.values()])
        names = np.repeat(np.arange(len(hits)), [len(x) for x in hits.values()])
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(hits), pa.string()).take(pa.array(names[np.argsort(rows, kind="stable")])))

    return run


def met_literals(text: Column, catalog: Catalog = BUILT_IN, rules: list[str] | None = None) -> Column:
    """What a batch tells of a text: the names of the patterns found (``batch_name``), and for other patterns the gate literals that stand in
    it, at every place the longest, which tells of its beginnings too."""
    literals, patterns, other = gate_literals(catalog, rules), [], {}
    for rule in catalog.rules if rules is None else rules:
        for pattern_id, (regex, nocase) in catalog.patterns[rule].items():
            gate = catalog.gates.get(rule, {}).get(pattern_id, ())
            if name := batch_name(rule, pattern_id, catalog):
                patterns.append((name, batch_regex(regex, nocase), () if "" in gate else tuple(map(blank, gate))))
            else:
                other.setdefault(rule, {})[pattern_id] = gate
    shown = gate_literals(Catalog(catalog.rules, {}, {}, other))
    if not patterns and not shown:
        return F.array().cast("array<string>")
    run = find_literals(literals, patterns, shown)

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        return run(texts)

    return find(text)


def hit_column(rule: str, pattern_id: str, text: Column, met: Column, catalog: Catalog = BUILT_IN, literals: list[str] | None = None) -> Column:
    """Whether a pattern is found. ``met``: what a batch told of the text (``met_literals``); the pattern runs only where its name or a literal of its gate is among it."""
    pattern, nocase = catalog.patterns[rule][pattern_id]
    found = text.rlike(java_regex(pattern, nocase))
    if name := batch_name(rule, pattern_id, catalog):
        return F.array_contains(met, F.lit(name)) & found
    gate = catalog.gates.get(rule, {}).get(pattern_id)
    if not gate or "" in gate:
        return found
    longer = [x for x in (gate_literals(catalog) if literals is None else literals) if x.startswith(tuple(map(blank, gate)))]
    return F.arrays_overlap(met, F.array(*[F.lit(x) for x in longer])) & found


def condition_column(condition, hit) -> Column:
    """A condition as a column; ``hit`` gives the column of a pattern id. Spark stops at the first term that decides."""
    if isinstance(condition, str):
        return hit(condition)
    kind, *terms = condition
    parts = [condition_column(t, hit) for t in terms]
    return ~parts[0] if kind == "not" else reduce((lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b), parts)


def used_ids(condition) -> list[str]:
    return [condition] if isinstance(condition, str) else [x for t in condition[1:] for x in used_ids(t)]


def rule_catalog(spark: SparkSession, catalog: Catalog = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """The catalog as two small tables: rules with their metadata (tags split from the category), and patterns."""
    rules = spark.createDataFrame([(r, *v) for r, v in catalog.rules.items()], "rule string, " + ", ".join(f"{m} string" for m in META))
    rules = rules.withColumn("tags", F.transform(F.split("category", ","), F.trim))
    patterns = [(r, p, rx, nocase) for r, ps in catalog.patterns.items() for p, (rx, nocase) in ps.items()]
    return rules, spark.createDataFrame(patterns, "rule string, pattern_id string, regex string, nocase boolean")


def write_catalog(spark: SparkSession, catalog: Catalog, path: str, mode: str = "error") -> None:
    """The catalog as JSON lines, a directory per phase and a line per rule; conditions are nested JSON arrays."""
    rows = []
    for r, meta in catalog.rules.items():
        patterns = [(p, rx, nocase, list(catalog.gates.get(r, {}).get(p, ()))) for p, (rx, nocase) in catalog.patterns.get(r, {}).items()]
        rows.append((r, *meta, patterns, json.dumps(catalog.conditions.get(r))))
    spark.createDataFrame(rows, STORED).coalesce(1).write.mode(mode).partitionBy("phase").json(path)


def read_catalog(spark: SparkSession, path: str) -> tuple[Catalog, DataFrame]:
    """The rules of a catalog directory, and what is wrong with the rest as rows (rule, problem).

    A rule that cannot be read, names an unknown pattern, holds a regular expression that does not compile, has no condition, or whose
    name is taken is skipped; the others load. A catalog is configuration and held by the driver, like the plan made of it.
    """
    lines = spark.read.schema(STORED + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    out, found = Catalog({}, {}, {}, {}), []
    for row in sorted(lines.collect(), key=lambda r: (r["phase"] or "", r["rule"] or "")):
        rule = row["rule"] or "?"
        if row["_corrupt_record"] is not None or row["rule"] is None:
            found.append((rule, "unreadable rule"))
            continue
        if rule in out.rules:
            found.append((rule, "rule defined twice"))
            continue
        patterns = {p["pattern_id"]: (p["regex"], bool(p["nocase"])) for p in row["patterns"] or []}
        condition = tuples(json.loads(row["condition"])) if row["condition"] else None
        wrong = catalog_problems(spark, Catalog({rule: ()}, {rule: patterns}, {} if condition is None else {rule: condition}, {}))
        if wrong:
            found += wrong
            continue
        out.rules[rule] = tuple(row[m] for m in META)
        out.patterns[rule], out.conditions[rule] = patterns, condition
        out.gates[rule] = {p["pattern_id"]: tuple(p["gate"]) for p in row["patterns"] if p["gate"]}
    return out, spark.createDataFrame(found, "rule string, problem string")


def tuples(condition):
    return tuple(tuples(t) for t in condition) if isinstance(condition, list) else condition


def catalog_problems(spark: SparkSession, catalog: Catalog = BUILT_IN) -> list[tuple[str, str]]:
    """(rule, problem) of rules without a condition, with an unknown pattern id, or with a pattern that does not compile."""
    compiler, found = spark.sparkContext._jvm.java.util.regex.Pattern, []
    for rule in catalog.rules:
        patterns, condition = catalog.patterns.get(rule, {}), catalog.conditions.get(rule)
        if condition is None:
            found.append((rule, "no condition"))
        else:
            found += [(rule, f"unknown pattern {p}") for p in used_ids(condition) if p not in patterns]
        for p, (regex, nocase) in patterns.items():
            try:
                compiler.compile(java_regex(regex or "", nocase))
            except Exception:  # noqa: BLE001  the gateway wraps the Java exception
                found.append((rule, f"pattern {p} does not compile"))
    return found
