"""Rule tables for sheets of a security workbook: what a row must have, what it may say, and what is put right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.rules import Rule, validate_sheet

# Permissions that a sheet may give, by scope, server roles, and kinds of logins.
DATABASE_PERMISSIONS = {
    "DATABASE": (
        "CONNECT", "SELECT", "INSERT", "UPDATE", "DELETE", "ALTER ANY SCHEMA", "ALTER ANY USER", "CONTROL", "CONTROL DATABASE", "CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE",
        "CREATE FUNCTION", "VIEW DATABASE STATE", "VIEW DEFINITION",
    ),
    "SCHEMA": ("SELECT", "INSERT", "UPDATE", "DELETE", "EXECUTE", "CONTROL", "ALTER", "REFERENCES", "VIEW DEFINITION"),
    "OBJECT": ("SELECT", "INSERT", "UPDATE", "DELETE", "EXECUTE", "REFERENCES", "CONTROL", "VIEW DEFINITION"),
}
SERVER_PERMISSIONS = {
    "SERVER": (
        "ALTER ANY CONNECTION", "ALTER ANY CREDENTIAL", "ALTER ANY ENDPOINT", "ALTER ANY EVENT SESSION", "ALTER ANY LINKED SERVER", "ALTER ANY LOGIN", "ALTER ANY SERVER AUDIT",
        "ALTER ANY SERVER ROLE", "ALTER ANY AVAILABILITY GROUP", "ALTER RESOURCES", "ALTER SETTINGS", "ALTER TRACE", "AUTHENTICATE SERVER", "CONTROL SERVER", "CONNECT SQL", "CREATE ANY DATABASE",
        "CREATE DDL EVENT NOTIFICATION", "EXTERNAL ACCESS ASSEMBLY", "IMPERSONATE ANY LOGIN", "SELECT ALL USER SECURABLES", "SHUTDOWN", "UNSAFE ASSEMBLY", "VIEW ANY DATABASE",
        "VIEW ANY DEFINITION", "VIEW SERVER STATE", "ADMINISTER BULK OPERATIONS",
    ),
    "ENDPOINT": ("CONNECT", "ALTER", "CONTROL", "TAKE OWNERSHIP", "VIEW DEFINITION"),
    "AVAILABILITY_GROUP": ("ALTER", "CONTROL", "VIEW DEFINITION", "TAKE OWNERSHIP"),
}
SERVER_ROLES = "sysadmin|securityadmin|serveradmin|processadmin|setupadmin|diskadmin|bulkadmin|dbcreator"
LOGIN_TYPES = "SQL|WINDOWS|EXTERNAL"

#: Sheet: its rules in order, and the columns that make two rows alike.
SHEETS: dict[str, tuple[list[Rule], list[str]]] = {
    "Roles": ([Rule("required", "RoleName", reason="no role"), Rule("longest", "RoleName", "128", "role too long")], ["RoleName"]),
    "Users": (
        [
            Rule("upper", "AuthType"), Rule("default", "DefaultSchema", "dbo"), Rule("required", "UserName", reason="no user"), Rule("required", "AuthType", reason="no kind"),
            Rule("one_of", "AuthType", "LOGIN|WITHOUT_LOGIN|EXTERNAL", "kind unknown"), Rule("required_if", "LoginName", "AuthType=LOGIN", "no login"),
        ],
        ["UserName", "AuthType", "LoginName"],
    ),
    "Permissions": (
        [
            Rule("default", "State", "GRANT"), Rule("upper", "State"), Rule("upper", "Scope"), Rule("upper", "Permission"), Rule("yes_no", "WithGrantOption", "false"),
            *[Rule("required", c, reason=f"no {c}") for c in ("RoleName", "Scope", "Permission")],
            Rule("known", "RoleName", "roles", "role not in Roles"), Rule("one_of", "State", "GRANT|DENY", "state unknown"), Rule("one_of", "Scope", "DATABASE|SCHEMA|OBJECT", "scope unknown"),
            Rule("required_if", "SchemaName", "Scope=SCHEMA|OBJECT", "no schema"), Rule("required_if", "ObjectName", "Scope=OBJECT", "no object"),
            Rule("allowed", "Permission", "database_permissions, by=Scope", "not for this scope"), Rule("clear", "WithGrantOption", "State=DENY", "a denial grants nothing"),
        ],
        ["RoleName", "State", "Scope", "SchemaName", "ObjectName", "Permission", "WithGrantOption"],
    ),
    "Memberships": (
        [Rule("required", "UserName", reason="no user"), Rule("required", "RoleName", reason="no role"), Rule("known", "RoleName", "roles", "role not in Roles")],
        ["UserName", "RoleName"],
    ),
    "ServerPermissions": (
        [
            *[Rule("upper", c) for c in ("State", "Scope", "Permission")], Rule("yes_no", "WithGrantOption", "false"),
            *[Rule("required", c, reason=f"no {c}") for c in ("LoginName", "State", "Scope", "Permission")],
            Rule("one_of", "State", "GRANT|DENY", "state unknown"), Rule("one_of", "Scope", "SERVER|ENDPOINT|AVAILABILITY_GROUP", "scope unknown"),
            Rule("allowed", "Permission", "server_permissions, by=Scope", "not for this scope"), Rule("required_if", "EndpointName", "Scope=ENDPOINT", "no endpoint"),
            Rule("required_if", "AGName", "Scope=AVAILABILITY_GROUP", "no group"), Rule("clear", "WithGrantOption", "State=DENY", "a denial grants nothing"),
        ],
        ["LoginName", "State", "Scope", "EndpointName", "AGName", "Permission", "WithGrantOption"],
    ),
    "ServerRoleMemberships": (
        [Rule("required", "LoginName", reason="no login"), Rule("required", "ServerRoleName", reason="no role"), Rule("lower_one_of", "ServerRoleName", SERVER_ROLES, "role not in the list")],
        ["LoginName", "ServerRoleName"],
    ),
    "Logins": (
        [
            Rule("upper", "LoginType"), Rule("required", "LoginName", reason="no login"), Rule("required", "LoginType", reason="no kind"), Rule("one_of", "LoginType", LOGIN_TYPES, "kind unknown"),
            Rule("default", "PasswordMode", "PLAIN"), Rule("upper", "PasswordMode"), Rule("forget", "PasswordMode", "LoginType<>SQL"), Rule("forget", "Password", "LoginType<>SQL"),
            Rule("forget", "PasswordHash", "LoginType<>SQL"), Rule("one_of_if", "PasswordMode", "PLAIN|HASHED, LoginType=SQL", "password mode unknown"),
            Rule("required_if", "Password", "PasswordMode=PLAIN", "no password"), Rule("required_if", "PasswordHash", "PasswordMode=HASHED", "no hash"),
        ],
        ["LoginName"],
    ),
    "Endpoints": (
        [
            *[Rule("upper", c) for c in ("EndpointType", "State", "Role", "Encryption", "Algorithm")], Rule("default", "State", "STARTED"), Rule("default", "Role", "ALL"),
            Rule("default", "Encryption", "REQUIRED"), Rule("default", "Algorithm", "AES"), Rule("default", "Authentication", "WINDOWS NEGOTIATE"), Rule("default", "OwnerLogin", "sa"),
            Rule("whole", "Port", reason="port is no number"), Rule("required", "EndpointName", reason="no endpoint"), Rule("one_of", "EndpointType", "DATABASE_MIRRORING", "kind unknown"),
            Rule("repair", "State", "STOPPED|STARTED", "state taken as STARTED"), Rule("repair", "Role", "PARTNER|WITNESS|PRIMARY|SECONDARY|ALL", "role taken as ALL"),
            Rule("repair", "Encryption", "DISABLED|REQUIRED", "encryption taken as REQUIRED"), Rule("repair", "Algorithm", "AES|AES", "algorithm taken as AES"),
        ],
        ["EndpointName"],
    ),
}


def validate(df: DataFrame, sheet: str, order: str, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Good and rejected rows of a sheet, whose columns must be there; ``roles(RoleName)`` are the good rows of Roles."""
    rules, key = SHEETS[sheet]
    lacking = {r.column for r in rules} - set(df.columns)
    if lacking:
        raise ValueError(f"sheet {sheet} lacks {', '.join(sorted(lacking))}")
    tables = {"database_permissions": pairs(df.sparkSession, DATABASE_PERMISSIONS), "server_permissions": pairs(df.sparkSession, SERVER_PERMISSIONS)}
    if roles is not None:
        tables["roles"] = roles.select("RoleName")
    return validate_sheet(df, rules, key, order, tables)


def pairs(spark: SparkSession, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, values in lists.items() for v in values], "scope string, permission string")
