"""skirmish.sources"""
