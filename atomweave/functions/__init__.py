"""Pure Column builders; nothing here touches a session."""
