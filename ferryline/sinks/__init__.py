"""Writers: segmented files and topics."""
