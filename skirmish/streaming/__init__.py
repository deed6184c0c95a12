"""skirmish.streaming"""
