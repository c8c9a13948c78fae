"""Sources and sinks: tables, HTML, PageSpeed JSON, workbooks."""
