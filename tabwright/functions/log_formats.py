"""The line patterns of the known log formats and the order in which they are tried."""

ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+|-)'
NGINX = r'^(\S+)\s+-\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+)'
ACCESS_USER = r"^(\S+)\s+\S+\s+(\S+)\s+\["
SYSLOG = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)"
APPLICATION = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\s+\[([^\]]+)\]\s+(.*)"
)
TRIED = [("apache", ACCESS), ("nginx", NGINX), ("application", APPLICATION), ("syslog", SYSLOG)]
LEADING_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}[^\s]*"
