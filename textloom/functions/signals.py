"""What a source text says of its surroundings: endpoints, hosts, variables, stores, brokers, sockets. Column to Column.

All in expressions: each signal is a number of pattern matches on the text column, none of which leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns decide which signals are found, so they must be those of the survey.
ENDPOINTS = (
    r"""@\w+\.(?:route|get|post|put|patch|delete|websocket)\(\s*["']([^"']+)["']""",
    r"""\b\w+\.(?:get|post|put|patch|delete|use)\(\s*["'](/[^"']*)["']""",
    r"""\.(?:HandleFunc|Handle)\(\s*"([^"]+)\"""",
    r"""@(?:Get|Post|Put|Delete|Request)Mapping\(\s*["']([^"']+)["']""",
    r"""\[(?:HttpGet|HttpPost|HttpPut|HttpPatch|HttpDelete|Route)\(\s*["']([^"']+)["']""",
    r"""\.Map(?:Get|Post|Put|Patch|Delete|Group)\(\s*["']([^"']+)["']""",
    r"""#\[(?:get|post|put|patch|delete|head|route)\(\s*"([^"]+)\"""",
    r"""\.route\(\s*"(/[^"]*)\"""",
)
VARIABLES = (
    r"""os\.environ(?:\.get)?\(\s*["']([A-Z0-9_]+)["']""",
    r"""os\.environ\[\s*["']([A-Z0-9_]+)["']""",
    r"""os\.getenv\(\s*["']([A-Z0-9_]+)["']""",
    r"""process\.env\.([A-Z0-9_]+)""",
    r"""getenv\(\s*["']([A-Z0-9_]+)["']""",
    r"""System\.getenv\(\s*["']([A-Z0-9_]+)["']""",
    r"""Environment\.GetEnvironmentVariable\(\s*["']([A-Za-z0-9_]+)["']""",
    r"""\benv::var(?:_os)?\(\s*"([A-Z0-9_]+)\"""",
)
CONFIGURATION = r"""\bConfiguration\[\s*["']([A-Za-z0-9_:.\-]+)["']"""
CONFIGURED = r"\b(?:IConfiguration|ConfigurationBuilder|AddJsonFile|builder\.Configuration|Microsoft\.Extensions\.Configuration)\b"
CLIENTS = (
    r"\b(?:requests\.(?:get|post|put|patch|delete)|httpx\.(?:get|post|put|patch|delete|Client|AsyncClient)|urllib\.request|urlopen|fetch\(|axios\.|http\.(?:Get|Post|NewRequest)"
    r"|curl_easy_perform|CURLOPT_URL|WinHttp(?:Open|Connect)|new\s+HttpClient|\.(?:GetAsync|PostAsync|PutAsync|PatchAsync|DeleteAsync|SendAsync|GetStringAsync|GetByteArrayAsync|GetStreamAsync)\("
    r"|reqwest::(?:get|Client|blocking)|hyper::Client|\bureq::(?:get|post|request))"
)
QUOTED_URL = r"""["'`]https?://([A-Za-z0-9._\-]+(?::\d+)?)"""
NAMESPACE_LINE = (
    r"(?i)(?:\b(?:xmlns|targetNamespace|schemaLocation|namespaceURI|XmlRoot|XmlType|XmlElement|XmlAttribute|XmlSerializer|DataContract|WebServiceBinding"
    r"|SoapType|SoapDocumentMethod|WebService)\b|\bNamespace\s*=)"
)
NO_TARGETS = (
    "apache.org", "gnu.org", "fsf.org", "opensource.org", "creativecommons.org", "mozilla.org", "w3.org", "xml.org", "json-schema.org", "schema.org", "oasis-open.org",
    "example.com", "example.org", "example.net", "tempuri.org", "xmlsoap.org", "openxmlformats.org", "purl.org", "iana.org", "dublincore.org", "docbook.org",
)
DYNAMIC = "(dynamic http client)"
DATASTORES = {
    "PostgreSQL": r"(?i)\b(psycopg2?|asyncpg|postgres(?:ql)?|npgsql|tokio_postgres)\b",
    "MySQL": r"(?i)\b(pymysql|mysqlclient|mysql\.connector|mysqlconnector)\b",
    "SQLite": r"(?i)\b(sqlite3|sqlite|microsoft\.data\.sqlite|rusqlite)\b",
    "SQLAlchemy": r"(?i)\bsqlalchemy\b",
    "SQLx": r"(?i)\bsqlx\b",
    "Diesel (ORM)": r"(?i)\bdiesel\b",
    "SQL Server": r"\b(SqlConnection|(?:System|Microsoft)\.Data\.SqlClient)\b",
    "Entity Framework": r"\b(DbContext|EntityFrameworkCore|AddDbContext)\b",
    "Redis": r"(?i)\b(redis|StackExchange\.Redis)\b",
    "MongoDB": r"(?i)\b(pymongo|mongodb|motor|MongoClient)\b",
    "Elasticsearch": r"(?i)\belasticsearch\b",
    "S3": r"(?i)\b(boto3|s3\.|aws_s3)\b",
}
MESSAGING = {
    "Kafka": r"(?i)\b(kafka|confluent[_.]?kafka|aiokafka|rdkafka|KafkaProducer|KafkaConsumer|sarama|segmentio/kafka)\b",
    "RabbitMQ/AMQP": r"(?i)\b(rabbitmq|amqp|amqplib|pika|kombu|RabbitMQ\.Client|streadway|lapin)\b",
    "MQTT": r"(?i)\b(mqtt|paho|mosquitto|aiomqtt|MqttClient)\b",
    "ZeroMQ": r"(?i)\b(zeromq|pyzmq|libzmq|zmq|NetMQ)\b",
    "NATS": r"(?i)\b(nats|async[_-]?nats|nats\.aio)\b",
    "Pulsar": r"(?i)\b(pulsar|apache[_-]?pulsar)\b",
    "ActiveMQ/STOMP": r"(?i)\b(activemq|stomp)\b",
    "NSQ": r"(?i)\b(nsq|go-nsq)\b",
    "AWS SQS/SNS": r"""(?i)\b(?:aws[_.]?(?:sqs|sns)|(?:sqs|sns)[_.]?client|boto3?\.(?:client|resource)\(\s*["'](?:sqs|sns)["']|@aws-sdk/client-s(?:qs|ns))\b|amazon(?:sqs|sns)""",
    "Azure Service Bus": r"(?i)\b(servicebus|ServiceBusClient|azure[._-]servicebus)\b",
    "GCP Pub/Sub": r"(?i)\b(pubsub_v1|google\.cloud\.pubsub|gcloud[_-]?pubsub)\b",
    "MSMQ / .NET bus": r"\b(MessageQueue|System\.Messaging|MSMQ|MassTransit|NServiceBus|Rebus)\b",
    "ZeroMQ/nanomsg": r"(?i)\b(nanomsg|nng)\b",
    "cFE Software Bus": r"\bCFE_SB_(?:TransmitMsg|TransmitBuffer|SendMsg|Subscribe|SubscribeEx|Unsubscribe|ReceiveBuffer|RcvMsg|CreatePipe|DeletePipe)\b",
    "Message bus (generic)": r"(?i)\b(EventBus|MessageBus|MessageBroker|event_bus|message_bus|message_broker)\b",
}
SOCKETS = {
    "TCP socket": r"""\bSOCK_STREAM\b|\bOS_SocketType_STREAM\b|\bTcpClient\b|\bTcpListener\b|\bTcpStream\b|\bServerSocket\b|net\.(?:Listen|Dial)\(\s*["']tcp|\.createServer\(""",
    "UDP socket": r"\bSOCK_DGRAM\b|\bOS_SocketType_DATAGRAM\b|\bUdpClient\b|\bDatagramSocket\b|\bUdpSocket\b|\.createSocket\(|net\.(?:ListenUDP|DialUDP)\b|\brecvfrom\s*\(|\bsendto\s*\(",
    "Unix socket": r"\bAF_UNIX\b|\bAF_LOCAL\b",
}
ANY_SOCKET = {"Socket (generic)": r"\bAF_INET6?\b|\bsocket\.socket\b|\bSystem\.Net\.Sockets\b|\bOS_Socket(?:Open|Bind|Connect|Accept|RecvFrom|SendTo)\b|\bgetaddrinfo\s*\(|\bsetsockopt\s*\("}
NAMING_PREFIX = r'"[A-Za-z][A-Za-z0-9]{0,23}[-_]"'
# End of the fixed values.


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _every(text: Column, patterns: tuple[str, ...]) -> Column:
    """Matches of all patterns, pattern by pattern, each value once."""
    return F.array_distinct(F.flatten(F.array(*(_found(text, p) for p in patterns))))


def _named(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def endpoints(text: Column) -> Column:
    """Addresses that the file serves."""
    return _every(text, ENDPOINTS)


def env_vars(text: Column) -> Column:
    """Variables that the file reads; configuration keys only where it has a configuration."""
    keys = F.when(text.rlike(CONFIGURED), _found(text, CONFIGURATION)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_every(text, VARIABLES), keys))


def outbound(text: Column) -> Column:
    """Hosts that the file calls, if it drives a client at all; a note where none is written out."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda line: ~line.rlike(NAMESPACE_LINE))
    bare = lambda host: F.lower(F.substring_index(host, ":", 1))
    known = "^(?:schemas|ns)\\.|(?:^|\\.)(?:" + "|".join(h.replace(".", "\\.") for h in NO_TARGETS) + ")$"
    hosts = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda line: _found(line, QUOTED_URL))), lambda host: ~bare(host).rlike(known))))
    return F.when(~text.rlike(CLIENTS), F.array().cast("array<string>")).when(F.size(hosts) == 0, F.array(F.lit(DYNAMIC))).otherwise(hosts)


def datastores(text: Column) -> Column:
    return _once(F.regexp_replace(text, NAMING_PREFIX, '""'), lambda bare: _named(bare, DATASTORES))


def messaging(text: Column) -> Column:
    return _once(F.regexp_replace(text, NAMING_PREFIX, '""'), lambda bare: _named(bare, MESSAGING))


def sockets(text: Column) -> Column:
    """Sockets by transport; the generic kind only where none is told."""
    told = _named(text, SOCKETS)
    return F.when(F.size(told) > 0, told).otherwise(_named(text, ANY_SOCKET))


def side_effects(row: dict[str, Column]) -> Column:
    """Sentences on what a file does to its surroundings."""
    joined = lambda name: F.array_join(row[name], ", ")
    count = lambda name: F.size(row[name]).cast("string")
    told = {
        "endpoints": F.concat(F.lit("exposes "), count("endpoints"), F.lit(" HTTP endpoint(s)")),
        "outbound_calls": F.lit("makes outbound network calls"),
        "datastores": F.concat(F.lit("accesses "), joined("datastores")),
        "messaging": F.concat(F.lit("uses messaging: "), joined("messaging")),
        "sockets": F.concat(F.lit("uses sockets: "), joined("sockets")),
        "env_vars": F.concat(F.lit("reads "), count("env_vars"), F.lit(" env var(s)")),
    }
    return F.array_compact(F.array(*(F.when(F.size(row[name]) > 0, sentence) for name, sentence in told.items())))


def io_signals(text: Column) -> dict[str, Column]:
    """All signals by the name of their column in a file's summary."""
    return {"endpoints": endpoints(text), "outbound_calls": outbound(text), "datastores": datastores(text), "messaging": messaging(text), "sockets": sockets(text), "env_vars": env_vars(text)}
